"""Operator 8: licence scans by a trained paragraph classifier, with DataFrame functions alone.

Sparse word n-grams (one and two words) of a paragraph go through a multinomial logistic
regression over the licence families and a class for everything else. It is trained on windows
of the templates below and on a bounded sample of the table's own distinct paragraphs that share
no three-word run with a template. A paragraph (line) is classified by overlapping windows of SPAN
words, so that a notice within a longer text isn't outweighed by what stands around it.

The unknown class is calibrated on all paragraphs: the least threshold, FLOOR or more, that at
most one in FALSE_SHARE of them reaches with a window that shares no three-word run with a
template.

A notice may be wrapped: lines of one family that follow each other, with up to GAP lines between, are
one run. A prediction counts once the windows that made it hold most word pairs of one of the
family's templates, over the run, pairs across its line ends included, whatever else its lines say: holder names,
comment marks (no marks are words), or a text before and after. A line of several confirmed runs counts for
the surest; a run that keeps a line is one notice.

Every paragraph of every text is classified, however long, window by window. Null and empty
texts have no paragraphs; rows are known by their id and text, so null ids keep their notices, rows that share an id have
those of their own text, and repeated rows get equal results; without sampled paragraphs the
templates alone train the model; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.common import documents
from gazette.sources.tables import Workspace, materialise

# Families and the wording that their notices use.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This software is licensed under the MIT License. See the LICENSE file for details."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-3.0", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd-3-clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-3-clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD style license that can be found in the LICENSE file."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."),
]
OTHER = "none"
FEATURES = 1 << 14
SAMPLE = 8000  # distinct paragraphs for class none
FALSE_SHARE = 1000
FLOOR, CEILING = 0.5, 0.99
CONFIRM = 0.6
#: Lines without a prediction that may stand within a notice.
GAP = 2
#: What a row is known by.
ROW = ("doc_id", "text_id")
WINDOW = 6  # words; shorter templates are used whole
SPAN, STEP = 16, 8  # words of a paragraph that are classified together, and from one such window to the next


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def spans(ws: Column) -> Column:
    """Windows of SPAN words, STEP apart, over all words; one window if there are no more."""
    starts = lambda x: F.sequence(F.lit(0), F.greatest(F.size(x) - (SPAN - STEP) - 1, F.lit(0)), F.lit(STEP))
    return let(ws, lambda x: F.transform(starts(x), lambda i: F.slice(x, i + 1, SPAN)))


def grams(ws: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; ws must be a column or bound by let()."""
    runs = F.transform(ws, lambda w, i: F.concat_ws(" ", w, *[F.get(ws, i + k) for k in range(1, n)]))
    return F.slice(runs, 1, F.greatest(F.size(ws) - n + 1, F.lit(0)))


def terms(ws: Column) -> Column:
    """Words, then word pairs: 2 n - 1 terms of n words."""
    pair = lambda a, b: F.concat(a, F.lit(" "), b)
    return let(ws, lambda x: F.concat(x, F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.size(x)), pair)))


def term_spans(ws: Column) -> Column:
    """terms() of each of spans(), from word pairs that are joined once a line."""
    pair = lambda a, b: F.concat(a, F.lit(" "), b)
    joined = lambda x: F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.size(x)), pair)
    starts = lambda x: F.sequence(F.lit(0), F.greatest(F.size(x) - (SPAN - STEP) - 1, F.lit(0)), F.lit(STEP))
    return let(ws, lambda x: let(joined(x), lambda y: F.transform(starts(x), lambda i: F.concat(F.slice(x, i + 1, SPAN), F.slice(y, i + 1, SPAN - 1)))))


def single(found: Column) -> Column:
    """The words among terms()."""
    return F.slice(found, F.lit(1), F.expr("(size(terms) + 1) div 2").cast("int"))


def pairs(found: Column) -> Column:
    """The word pairs among terms()."""
    return F.slice(found, F.expr("(size(terms) + 1) div 2 + 1").cast("int"), F.size(found))


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TEMPLATES, "family string, text string")
    return rows.withColumn("words", words(F.col("text")))


def families() -> list[str]:
    return [OTHER, *sorted({f for f, _ in TEMPLATES})]


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, paragraph and line, for lines that have words."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.where(F.col("line").rlike(r"[\p{L}\p{N}]"))


def survey(docs: DataFrame) -> tuple[int, int]:
    """How many paragraphs there are, and about how many distinct ones."""
    found = paragraphs(docs).agg(F.count("*"), F.approx_count_distinct(F.xxhash64("line"))).first()
    return found[0], found[1]


def _with_terms(df: DataFrame) -> DataFrame:
    return df.withColumn("terms", terms(F.col("words"))).drop("words")


def _label() -> Column:
    return F.array_position(F.array(*map(F.lit, families())), F.col("family")).cast("double") - 1


def _least(rows: DataFrame, n: int, share: int = 4, distinct: int | None = None) -> DataFrame:
    """at and line of the n least distinct hashes "at", of which there are about distinct; fewer only if there are no more.

    Only a part of the hashes' range that should hold share * n distinct ones is gathered, so
    that what one task gets doesn't grow with the input. Copies of a line are one row.
    """
    distinct = rows.agg(F.approx_count_distinct("at")).first()[0] if distinct is None else distinct
    part = share * n / max(1, distinct)
    taken = rows if part >= 1 else rows.where(F.col("at") < int(part * 2**64) - 2**63)
    return taken.groupBy("at").agg(F.min("line").alias("line")).orderBy("at").limit(n)


def _runs(spark: SparkSession) -> Column:
    """The three-word runs of the templates, as an array."""
    runs = templates(spark).select(F.explode(grams(F.col("words"), 3)).alias("run")).distinct().orderBy("run").collect()
    return F.array(*[F.lit(r.run) for r in runs])


def train(docs: DataFrame, sample: int = SAMPLE, distinct: int | None = None) -> PipelineModel:
    """The model, from the templates and at most sample paragraphs without a run of theirs, of about distinct ones."""
    spark = docs.sparkSession
    distinct = survey(docs)[1] if distinct is None else distinct
    known = templates(spark)
    last = F.greatest(F.size("words") - WINDOW, F.lit(0))
    windows = known.select("family", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, WINDOW))).alias("words"))
    wholes = known.select("family", "words")
    # Paragraphs whose hashes are least: the same ones however the table is partitioned.
    least = _least(paragraphs(docs).select(F.xxhash64("line").alias("at"), "line"), sample, distinct=distinct).withColumn("words", words(F.col("line")))
    clean = least.where(~F.arrays_overlap(let(F.col("words"), lambda x: grams(x, 3)), _runs(spark))).select("at", F.explode(spans(F.col("words"))).alias("words"))
    # One window of each paragraph trains, so that long ones don't make the sample grow.
    mine = clean.groupBy("at").agg(F.min_by("words", F.xxhash64("words")).alias("words")).select(F.lit(OTHER).alias("family"), "words")
    rows = _with_terms(windows.unionByName(wholes).unionByName(wholes).unionByName(mine)).withColumn("label", _label()).persist()
    try:
        share = rows.groupBy("family").agg((1 / F.count("*")).alias("weight"))
        weighted = rows.join(F.broadcast(share), "family").coalesce(4)
        pipeline = Pipeline(stages=[HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True), LogisticRegression(maxIter=30, regParam=0.003, family="multinomial", weightCol="weight")])
        model = pipeline.fit(weighted)
        # Only probabilities are asked for; without raw scores they take one call a window instead of two.
        model.stages[-1].setRawPredictionCol("").setPredictionCol("")
        return model
    finally:
        rows.unpersist()


def likely_windows(docs: DataFrame, model: PipelineModel) -> DataFrame:
    """doc_id, text_id, paragraph, place, family, probability_of, pairs, first and last word and clean (no run of a template) of the windows that reach FLOOR."""
    windows = paragraphs(docs).select(*ROW, "paragraph", F.posexplode(term_spans(words(F.col("line")))).alias("place", "terms"))
    names = F.array(*map(F.lit, families()[1:]))
    p = F.slice(vector_to_array("probability"), 2, len(families()) - 1)
    # A generator of one row: the filter stays above it, else it would ask the model anew for each time it names the probability.
    scored = model.transform(windows).select(*ROW, "paragraph", "place", "terms", F.inline(F.array(F.struct(p.alias("p")))))
    likely = scored.withColumn("probability_of", F.array_max("p")).where(F.col("probability_of") >= FLOOR)
    likely = likely.withColumns({"family": F.element_at(names, F.array_position("p", F.col("probability_of")).cast("int")), "words": single(F.col("terms"))})
    clean = ~F.arrays_overlap(let(F.col("words"), lambda x: grams(x, 3)), _runs(docs.sparkSession))
    ends = [F.element_at("words", 1).alias("first"), F.element_at("words", -1).alias("last")]
    return likely.select(*ROW, "paragraph", "place", "family", "probability_of", pairs(F.col("terms")).alias("pairs"), *ends, clean.alias("clean"))


def calibrated(likely: DataFrame, n_paragraphs: int, false_share: int = FALSE_SHARE) -> float:
    """The least threshold from FLOOR that at most one in false_share of all paragraphs reaches with a clean window."""
    each = likely.where("clean").groupBy(*ROW, "paragraph").agg(F.max("probability_of").alias("p"))
    n = each.count()
    allowed = n_paragraphs // false_share
    if n <= allowed:
        return FLOOR
    # Of n values all but the allowed ones must stay below.
    cut = each.agg(F.expr(f"percentile_approx(p, {1 - allowed / n}, 10000)")).first()[0]
    return min(CEILING, max(FLOOR, math.nextafter(cut, 1.0)))


def scan(docs: DataFrame, model: PipelineModel, threshold: float | None = None, confirm: float = CONFIRM, n_paragraphs: int | None = None) -> DataFrame:
    """doc_id, text_id, paragraph (the first), n_lines, family, probability, likeness of the notices; the threshold is calibrated on docs if none is given.

    text_id is the xxhash64 of the text; rows that repeat both are one.
    """
    spark = docs.sparkSession
    with Workspace(spark, "license_scan") as tables:
        likely = tables.write(likely_windows(docs, model), "likely")
        if threshold is None:
            threshold = calibrated(likely, survey(docs)[0] if n_paragraphs is None else n_paragraphs)
        return materialise(_confirmed(likely.where(F.col("probability_of") >= threshold), confirm), "licensed")


def _confirmed(likely: DataFrame, confirm: float) -> DataFrame:
    own = F.array_distinct(F.flatten(F.collect_list("pairs")))
    lines = likely.groupBy(*ROW, "paragraph", "family").agg(F.max("probability_of").alias("probability"), own.alias("pairs"), F.min_by("first", "place").alias("first"), F.max_by("last", "place").alias("last"))
    order = Window.partitionBy(*ROW, "family").orderBy("paragraph")
    lines = lines.withColumns({"before": F.lag("paragraph").over(order), "ended": F.lag("last").over(order)})
    begins = F.col("before").isNull() | (F.col("paragraph") > F.col("before") + GAP + 1)
    across = F.when(F.col("paragraph") == F.col("before") + 1, F.array(F.concat("ended", F.lit(" "), "first"))).otherwise(F.array().cast("array<string>"))
    lines = lines.withColumns({"run": F.sum(begins.cast("int")).over(order), "pairs": F.concat("pairs", across)})
    found = lines.groupBy(*ROW, "family", "run").agg(F.max("probability").alias("probability"), own.alias("pairs"), F.collect_set("paragraph").alias("lines"))
    known = templates(likely.sparkSession).where(F.size("words") > 1).groupBy("family").agg(F.collect_list(F.array_distinct(grams(F.col("words"), 2))).alias("templates"))
    found = found.join(F.broadcast(known), "family")  # one row per family
    alike = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.size(t)))
    found = found.withColumn("likeness", alike).where(F.col("likeness") >= confirm)
    # Lines of several families' runs count for the likeliest one.
    best = F.max(F.struct("probability", "likeness", "family", "run")).alias("best")
    kept = found.withColumn("paragraph", F.explode("lines")).groupBy(*ROW, "paragraph").agg(best)
    return kept.groupBy(*ROW, F.col("best.family").alias("family"), F.col("best.run").alias("run")).agg(F.min("paragraph").alias("paragraph"), F.count("*").alias("n_lines"), F.max("best.probability").alias("probability"), F.max("best.likeness").alias("likeness")).drop("run")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its paragraphs with words, notices, families in order, the surest family's probability."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    n_paragraphs, distinct = survey(docs)
    found = scan(docs, train(docs, distinct=distinct), n_paragraphs=n_paragraphs).groupBy(*ROW).agg(F.count("*").alias("n_licensed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("probability").alias("probability"))
    has_words = lambda x: x.rlike(r"[\p{L}\p{N}]")
    total = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.coalesce(F.size(F.filter(F.split("text", "\n"), has_words)), F.lit(0)).cast("long").alias("n_paragraphs"))
    same = F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("t.text_id") == F.col("f.text_id"))
    return total.alias("t").join(found.alias("f"), same, "left").select("t.doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0)).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), "probability")

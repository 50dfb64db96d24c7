import random

import corpus_pipeline
from gazette.llm import near_dedup


def test_each_stage_takes_what_it_is_for(spark, tmp_path):
    """Toxic documents go, a line of many sites goes from the others, one of each group of near copies stays, all that is left is packed."""
    rng = random.Random(2)
    calm = [f"{a}{b}" for a in ("river", "stone", "garden", "letter", "window", "market", "summer", "castle") for b in ("", "s", "side", "work")]
    rude = ["idiotic", "stupid", "hateful", "filthy", "vermin", "scum", "loser", "moron", "disgusting", "pathetic"]
    line = "Sign up for our weekly letter today"
    text = lambda words, i: f"{' '.join(rng.choice(words) for _ in range(80))} number {i}"
    rows, labels = [], []
    for i in range(120):
        toxic = i % 6 == 5
        body = text(rude + calm[:3] if toxic else calm, i)
        rows.append((i, f"{line}\n{body}" if i % 5 == 0 else body, "en", f"site{i % 12}", len(body)))
        if i < 90:
            labels.append((i, 1, int(toxic)))
    rows += [(200 + k, rows[k][1] + f" copy {k}", "en", "site1", 1) for k in (0, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxicity, lines, near, _ = (stage for _, stage in corpus_pipeline.STAGES)
    kept = toxicity(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, *_ in rows if i >= 200 or i % 6 != 5}
    kept = lines(spark, kept, str(tmp_path))
    texts = {r.doc_id: r.text for r in kept.collect()}
    plain = {i: t for i, t, *_ in rows}
    assert texts == {i: plain[i].removeprefix(f"{line}\n") for i in ids}
    kept = {r.doc_id for r in near(spark, kept, str(tmp_path)).collect()}

    def shingles(t):
        words = t.lower().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = {i: shingles(t) for i, t in texts.items()}
    gone = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone == {200, 206, 207} and kept == ids - gone
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept
    assert near_dedup.PERCENT > corpus_pipeline.NEAR_PERCENT

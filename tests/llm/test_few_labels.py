"""A label table with few toxic rows still gives the chain features."""
import random

from fusewright.llm import toxicity


def test_toxic_words_in_under_ten_labelled_rows(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(300)]
    bad = ["grumbo", "zorkel", "flaxer", "wimpod", "hudrin", "quelba"]
    docs, labels = [], []
    for k in range(500):
        toxic = k % 7 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))] + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        if k < 180:
            labels.append((k, 1, int(toxic)))
    seen = {b: sum(b in text for k, text in docs[:180]) for b in bad}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    chain = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    flagged = {r["doc_id"] for r in toxicity.score(frame, chain).collect() if r["doc_id"] >= 180 and r["p_toxic"] >= chain.links[-1].threshold}
    wanted = {k for k in range(180, 500) if k % 7 == 0}
    assert max(seen.values()) < 14 and min(seen.values()) < 10
    assert len(flagged & wanted) >= 0.9 * len(wanted) and len(flagged - wanted) <= 0.05 * 320

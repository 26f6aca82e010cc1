"""The five stages on a small table with known faults."""

import random

import corpus_pipeline


def made(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS _text", "'x' AS spans", "doc_id AS node").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, i % 2) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "q one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_do_their_work(spark, tmp_path):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    text = lambda letters, n=60: " ".join(word(letters) for _ in range(n))
    kind, mean = "abcdefgh", "uvwxyzkq"
    rows = [(i, text(mean if i % 2 else kind)) for i in range(40)]
    long = text(kind, 200)
    shared = text(kind, 20)
    rows += [
        (100, long), (101, long), (102, long + " end"),  # copies, one nearly
        (110, f"{text(kind)}\n{shared}"), (111, f"{shared}\n{text(kind)}"),  # a line twice
        (120, f"{text(kind)} q One two, three four five six seven eight nine ten"),  # a benchmark's window
        (130, text(mean)), (140, None), (141, ""), (None, text(kind)), (None, text(kind)), (150, text(kind)), (150, text(kind)), (160, text(kind, 5000)),
    ]
    made(spark, tmp_path, [(i, t, "en", "s", len(t or "")) for i, t in rows])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert not {1, 3, 5, 130} & by.keys() and {0, 2, 4, 160} <= by.keys()  # toxic ones go, clean ones stay
    assert 100 in by and 102 not in by
    assert sum(d in by for d in (101, 140, 141)) == 1  # its only line repeats, so 101 is left without words, and texts without words are copies
    assert 110 in by and 111 in by and shared in by[110][0].text and shared not in by[111][0].text
    assert 120 not in by
    assert len(by[None]) == 2 and len(by[150]) == 2  # rows of one id or none with unlike texts all stay
    assert all(r.decoded is not None and len(r.ids) == r.n_tokens for r in out)


def test_empty_table(spark, tmp_path):
    made(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

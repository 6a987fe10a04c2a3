"""The pipeline's stages, one after the other, on rows of every odd kind."""

import random

import corpus_pipeline


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(6)
    line = lambda n: " ".join(f"v{rng.randrange(300)}" for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        rows.append((i, "\n".join(line(25) if not bad else " | ".join(line(15).split()) for _ in range(4)), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    passage = line(30)
    rows += [(300, rows[1][1], "en", "s", 0), (301, line(50) + " " + passage, "en", None, 0), (302, line(50) + " " + passage, None, "s", None), (303, None, "en", "s", 0), (304, "", "en", "s", 0), rows[2]]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, str(tmp_path))
        if k < 3:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    good = {i for i in range(240) if i % 6}
    assert good <= set(seen[0]) and not {i for i in range(0, 240, 6)} & set(seen[0])
    assert 300 not in seen[1] and good <= set(seen[1]) and {301, 302} <= set(seen[1])
    assert seen[2][302]["text"].split() == dict((r[0], r[1]) for r in rows)[302].split()[:50]
    assert seen[2][302]["n_chars"] == len(seen[2][302]["text"]) and seen[2][301]["text"] == seen[1][301]["text"]
    assert set(seen[3]) == set(seen[2])
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert sum(x[2] for x in key(again)) == sum(x[2] for x in key(docs))


def test_stages_of_nothing_and_of_clashing_columns(spark, tmp_path):
    """Empty tables, no n_chars, and columns named as the operators name theirs."""
    names = "doc_id long, text string, score string, _score string, n_removed string, hit string, gone string, class_id string"
    text = " ".join(f"w{i}" for i in range(30))
    own = " ".join(f"v{i}" for i in range(60)) + " "
    rows = [(1, text, *"abcdef"), (2, text, *"abcdef"), (3, own + text, *"abcdef"), (None, None, *"abcdef")]
    for k, data in enumerate((rows, [])):
        at = f"{tmp_path}/{k}"
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.createDataFrame(data, names)
        for j, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, at)
            if j < 3:
                assert out.columns == docs.columns
            out.write.parquet(f"{at}/{j}")
            docs = spark.read.parquet(f"{at}/{j}")
            if j == 2 and data:
                left = {r["doc_id"]: r["text"] for r in docs.collect()}
                assert left == {1: text, 3: own, None: None} and {r["hit"] for r in docs.collect()} == {"d"}
        assert (docs.count() > 0) == bool(data)

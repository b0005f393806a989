"""The pipeline's stages on a small table."""

import corpus_pipeline
from lattica.llm import bpe, queries

from .rows import prose


def junk(i):
    return " ".join(x.upper() + "!!" for x in prose(40, i).split()) if i % 2 else " ".join([prose(1, i)] * 80)


def test_stages(spark, tmp_path):
    item = prose(30, 900)
    rows = [(i, junk(i) if i % 4 == 0 else prose(60, i).capitalize() + ".") for i in range(1, 400)]
    rows += [(1000, rows[0][1]), (1001, f"{prose(30, 5001)} {item} {prose(30, 5002)}"), (1002, prose(50, 5003) + " password=hunter2hunter2")]
    docs = [(d, t, "en", "src", len(t)) for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d % 4 != 0), 0) for d, _ in rows[:399]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert now.columns == columns
        ids.append({r.doc_id for r in now.collect()})
        if k == 3:
            texts = {r.doc_id: r for r in now.collect()}
    bad = {d for d, _ in rows if d % 4 == 0 and d < 1000}
    clean = {d for d, _ in rows} - bad
    assert len(ids[0] & bad) <= 0.05 * len(bad) and clean <= ids[0]
    assert 1000 not in ids[1] and 1 in ids[1]
    assert ids[1] - ids[2] == {1001} and ids[3] == ids[2] == ids[4]
    assert texts[1002].text.endswith(" [assign]") and texts[1002].n_chars == len(texts[1002].text)
    coder = bpe.coder(bpe.default_tokenizer())
    assert {r.doc_id: r.n_tokens for r in now.collect()} == {d: len(coder.encode(r.text)) // 4 for d, r in texts.items()}
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == ids[4]
    assert [int(n.split("_")[0][2:]) for n in queries.QUERIES] == list(range(1, 14))


def awkward(i):
    """Rows with nulls in any column, empty, repeated and long texts, repeated ids, and columns that clash with inner names."""
    item = prose(30, 900)
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, prose(60, 4)), (4, prose(60, 5)), (4, prose(60, 4)), (5, prose(60, 4)), (None, prose(60, 6)), (None, prose(60, 6)), (None, None), (6, f"{prose(30, 61)} {item} {prose(30, 62)}"), (None, item),
        (7, prose(20_000, 7)), (8, "password=hunter2hunter2"), (8, "password=hunter2hunter2"), (9, "a"), (10, "<|endoftext|>"),
    ]
    docs = [(d, t, None if k % 3 else "en", None if k % 4 else "src", None if k % 5 else len(t or ""), k, "z", b"k", 1.0) for k, (d, t) in enumerate(rows)]
    return rows, docs, item


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, node string, key binary, score double"


def test_awkward_rows_in_every_stage(spark, tmp_path):
    """Each stage on a small table against what is defined for it; and on an empty one."""
    rows, docs, item = awkward(0)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    where = str(tmp_path)
    count = lambda f: sorted((r.doc_id or -1, r.text or "") for r in f.collect())
    every = sorted((d or -1, t or "") for d, t in rows)
    # nothing to learn from: no document is rejected
    assert count(stages["quality classifier"](spark, df, where)) == every
    # one row of each text stays, of those with its smallest id; different texts with one id both stay; a null text is an empty one
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        key = " ".join((t or "").split()) if not (t or "").strip() else t
        first.setdefault(key, (d or -1, t or ""))
    kept = stages["SimHash near-dedup"](spark, df, where)
    assert count(kept) == sorted(first.values()) and kept.columns == df.columns
    clean = stages["benchmark decontamination"](spark, df, where)
    assert count(clean) == [r for r in every if item not in r[1]] and clean.columns == df.columns
    safe = stages["secret scans"](spark, df, where)
    assert count(safe) == sorted((d, t.replace("password=hunter2hunter2", "[assign]")) for d, t in every) and safe.columns == df.columns
    coded = stages["BPE encoding and decoding"](spark, df, where).collect()
    coder = bpe.coder(bpe.default_tokenizer())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in coded) == sorted((d or -1, len(coder.encode(t or "")) // 4) for d, t in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), where).count() == 0

"""Every stage against its own rule on its own input, and run() as their chain."""

import corpus_pipeline
import test_operators as ops

from dockcast.llm import mixing, quality

SF = ops.SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        given.append(stage(spark, given[-1], SF).cache())
    assert all(d.columns == columns for d in given[:-1])

    text = {r.doc_id: r.text for r in docs.collect()}
    ids = [sorted(r.doc_id for r in d.collect()) for d in given]
    # quality: labels say which documents are junk
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids[0]) - set(ids[1])
    assert sum(label[i] == 0 for i in gone if i in label) >= 0.9 * sum(i in label for i in gone)
    assert sum(i in gone for i in label if label[i] == 0) >= 0.5 * sum(y == 0 for y in label.values())
    # one of each group of links
    assert ids[2] == [i for i, _, c in sorted(ops.jaccard_brute([(i, text[i]) for i in ids[1]])) if i == c]
    # contaminated documents go, the others stay
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[3] == [i for i in ids[2] if not ops.contamination(text[i], bench)[4]]
    # copies as decided
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(given[3], repetition_limit=corpus_pipeline.REPETITION_LIMIT).collect()}
    assert ids[4] == sorted(i for i, n in copies.items() for _ in range(n))
    # the digest of every id stream
    start, want = 0, []
    for i, t in ops.expected_tokens([(i, text[i]) for i in ids[4]]):
        want.append((i, start, len(t), ops.zlib.crc32(ops.np.array(t, "<u4").tobytes())))
        start += len(t)
    assert rows(given[5]) == sorted(want, key=repr)
    assert rows(corpus_pipeline.run(spark, SF)) == rows(given[5])


def test_stages_with_odd_and_no_rows(spark):
    df = spark.createDataFrame(ops.ODD, ops.DOCS)
    assert quality.keep_good(df, quality.fit(df, spark.read.parquet(f"{SF}/labels.parquet"))).columns == df.columns
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, df.where("false"), SF)
        assert empty.count() == 0, name
        out = stage(spark, df, SF)
        out.collect()
        assert name == "token_files" or out.columns == df.columns


def test_token_files_are_stored_small(spark, tmp_path):
    """Ids in 16 bits each are not what the disk must hold: frequent ones take less."""
    import public_tokenizers

    from dockcast.llm import token_files

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    token_files.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), piece_bytes=1 << 16)
    packed = token_files.read_blocks(spark, str(tmp_path / "t")).selectExpr("sum(length(payload)) AS n").first().n
    assert sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet")) < 0.75 * packed

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftspan.llm import bpe, orc_tokens, packing, words
from driftspan.llm.tokens import chunk_encoder, default_path, library_tokenizer, word_encoder

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
AWKWARD = ["", "it's DON'T we'll 123 4.5!", "<|endoftext|> x<|startoftext|>y", "Größe ΣΑΣ ŞİŞLİ ﬁ", "日本語 テスト", "a\u0301 e\u0301 \u00a0x\u2003y\x1cz\x85", "\n\n  two\n lines \t end ", "x" * 3000, "🙂👩‍👩‍👧 ok", "a  b   c", "²½ ª ٣"]


@pytest.mark.parametrize("text", AWKWARD)
def test_encoders_equal_the_library(text):
    ids = library_tokenizer(WORD).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_encoder(WORD).encode(text.encode()), "<u4").tolist() == ids
    encoder, library = chunk_encoder(BYTE), library_tokenizer(BYTE)
    ids = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode([text.encode()])
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert encoder.decode(got).decode() == library.decode(ids, skip_special_tokens=False)


def test_bad_cuts_are_repaired():
    encoder, text = chunk_encoder(BYTE), "The unbelievable   story\n\n of  international cooperation, it's 12345."
    ids = library_tokenizer(BYTE).encode(text, add_special_tokens=False).ids
    for step in (1, 2, 5, 11):
        chunks = [text[i : i + step].encode() for i in range(0, len(text), step)]
        assert np.frombuffer(encoder.encode(chunks), "<u4").tolist() == ids


def test_round_trip(docs, pairs, empty):
    from hashlib import sha256

    library = library_tokenizer(BYTE)
    text = {d: t or "" for d, t in pairs}
    for r in bpe.round_trip(docs, BYTE).collect():
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == sha256(text[r["doc_id"]].encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert {r["doc_id"]: r["text"] for r in decoded.collect()} == text
    assert bpe.round_trip(empty, BYTE).count() == 0


def word_ids(pairs):
    return {d: np.array([*library_tokenizer(WORD).encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in pairs}


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_packing(docs, pairs, empty):
    ids = word_ids(pairs)
    rows = packing.pack_documents(docs, WORD, 256).collect()
    got = {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {d: len(x) for d, x in ids.items()}
    by = check_packed(rows, 256)
    assert sum(got.values()) > 0.93 * 256 * len(by)
    assert packing.pack_documents(empty, WORD).count() == 0


def test_packing_of_ties(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 10 + 1).cast("long").alias("length"), F.lit("same").alias("offset_"))
    by = check_packed(packing.pack(df, 16).collect(), 16)
    assert sum(len(x) for x in by.values()) == 1000
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(df, 5)
    assert packing.shortest_pack_first({}, 8) == [] and sorted(packing.shortest_pack_first({8: 3, 4: 2}, 8)) == [(1, [(4, 2)]), (3, [(8, 1)])]


def test_orc_files(spark, docs, pairs, empty, tmp_path):
    import pyarrow.orc

    ids, start = word_ids(pairs), 0
    folder = orc_tokens.write_documents(docs, WORD, str(tmp_path / "t"))
    got = {r["doc_id"]: r for r in orc_tokens.summary(spark, folder).collect()}
    for d in sorted(ids):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        start += len(ids[d])
    assert orc_tokens.read(spark, folder).where("doc_id = 17").first()["tokens"] == ids[17].tolist()
    plan = orc_tokens.read(spark, folder).where("doc_id = 17")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in plan
    files = sorted((tmp_path / "t").glob("*.orc"))
    assert sum(pyarrow.orc.ORCFile(f).nrows for f in files) == len(pairs)
    low = [pyarrow.orc.ORCFile(f).read(["doc_id"])["doc_id"].to_pylist() for f in files]
    assert [x for part in low for x in part] == sorted(ids)
    assert orc_tokens.summary(spark, orc_tokens.write_documents(empty, WORD, str(tmp_path / "e"))).count() == 0


def test_shared_chunks_come_from_the_table(spark):
    """Chunks that documents share are encoded by their owner alone; joins at line breaks and in other scripts are repaired."""
    import random

    rng = random.Random(4)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randrange(2, 8)))
    text = lambda letters, n: "".join(word(letters) + rng.choice([" ", " ", "\n", "\n\n", "  "]) for _ in range(n))
    passages = [text(letters, 900) for letters in ("abcdefghij", "абвгдежзий", "αβγδεζηθι")]
    rows = [(i % 7 if i % 5 else None, text("klmnop", rng.randrange(40)) + passages[i % 3] + text("klmnop", 20)) for i in range(30)]
    rows += [rows[3], (1, ""), (None, None), (99, passages[0] * 600)]  # a text of more than 4 MB
    library, repairs = library_tokenizer(BYTE), 0
    got = sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect())
    assert got == sorted((d or -1, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for d, t in rows)
    encoder = chunk_encoder(BYTE)
    for block in words.blocks(pa.array([t for _, t in rows[:30]])):
        for chunks in bpe.chunks_of(block):
            before = encoder.repairs
            encoder.encode(chunks)
            repairs += encoder.repairs - before
            assert len(chunks) > 5
    assert repairs > 10


def test_orc_stripes_indexes_and_bloom_filters(spark, tmp_path):
    """Footers of the files: several stripes, row groups, a Bloom filter on doc_id; a filter reads a part of the rows."""
    import pyarrow.orc

    n, folder = 40_000, str(tmp_path / "big")
    ids = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.pmod(F.xxhash64(i, "id"), F.lit(49_000)).cast("int"))
    rows = spark.range(0, n, 1, 1).select((F.col("id") * 2).alias("doc_id"), (F.col("id") * 400).alias("start_in_file"), F.lit(400).cast("long").alias("n_tokens"), ids.alias("tokens"))
    orc_tokens.write(rows, folder)
    (file,) = [str(f) for f in (tmp_path / "big").glob("*.orc")]
    assert pyarrow.orc.ORCFile(file).nstripes > 1
    orc, path = spark._jvm.org.apache.orc, spark._jvm.org.apache.hadoop.fs.Path(file)
    reader = orc.OrcFile.createReader(path, orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == orc_tokens.ROW_GROUP
    every = spark.sparkContext._gateway.new_array(spark._jvm.boolean, 6)
    for i in range(6):
        every[i] = True
    index = reader.rows().readRowIndex(0, every, every)
    assert index.getRowGroupIndex()[1].getEntryCount() > 1
    assert index.getBloomFilterIndex()[1].getBloomFilterCount() == index.getRowGroupIndex()[1].getEntryCount()

    def read_rows(condition):
        df = orc_tokens.read(spark, folder).where(condition).select("doc_id", "n_tokens")
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().head()
        return len(found), plan.metrics().apply("numOutputRows").value()

    assert read_rows("doc_id >= 0") == (n, n)
    found, scanned = read_rows("doc_id = 40000")
    assert found == 1 and 0 < scanned <= n // 4
    assert read_rows("doc_id = 40001") == (0, 0)  # within the range of a row group, but in no Bloom filter


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(5, "one two"), (5, "one two"), (5, "three"), (None, "four"), (None, None), (1, "five six seven")] + [(7, f"t{i}") for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, file string")
    got = orc_tokens.summary(spark, orc_tokens.write_documents(df, WORD, str(tmp_path / "r"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    expected = sorted(zlib.crc32(np.array([*library_tokenizer(WORD).encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in rows)
    assert sorted(r["ids_crc32"] for r in got) == expected
    packed = packing.pack_documents(df, WORD, 16).collect()
    assert sorted(r["ids_crc32"] for r in packed) == expected and len(check_packed(packed, 16)) > 1
    assert bpe.round_trip(df, BYTE).count() == len(rows)

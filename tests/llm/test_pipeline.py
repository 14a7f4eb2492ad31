import random

import pyarrow as pa
import pytest
from brute import near_duplicates, remove_repeats

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=f"{p.TOKENIZERS}/piece_bpe_32k.model")


def rows():
    rng = random.Random(12)
    vocab = {"xx": [f"ka{i}to" for i in range(300)], "yy": [f"schu{i}ng" for i in range(300)]}
    out, texts = [], []
    passage = " ".join(f"pass{i}" for i in range(70))
    for i in range(120):
        lang = "xx" if i % 3 else "yy"
        words = [rng.choice(vocab[lang]) for _ in range(rng.randint(20, 120))]
        if i % 10 == 0:
            words.insert(5, passage)
        texts.append(" ".join(words))
        out.append((i, texts[-1], lang if i % 7 else None, f"src{i % 4 if i % 2 else 0}", len(texts[-1])))
    out += [(200 + i, texts[i] + " tail", "xx", "src0", 0) for i in range(20)]
    out += [(300, None, None, "src0", 0), (301, "123 456", "xx", "src0", 7), (302, "", "yy", None, 0), (5, texts[5], "xx", "src0", len(texts[5])), (400, passage, "xx", "src1", len(passage))]
    return out


def test_against_plain_stages(spark, library, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = p.run(spark, str(tmp_path)).collect()
    left = {i: t for i, t, *_ in rows() if t and any(c.isalpha() for c in t)}
    kept = {i for i, x in near_duplicates(left.items(), 5, 80).items() if x[2]}
    left = {i: t for i, t in left.items() if i in kept}
    cut = remove_repeats(left.items(), p.PASSAGE)
    left = {i: (t if not cut[i][1] else cut[i][2]) for i, t in left.items() if cut[i][1] < cut[i][0]}
    assert {r.doc_id for r in got} == set(left)
    assert 400 not in left and 205 not in left and 10 in left
    for r in got:
        assert r.ids == library.encode(left[r.doc_id]) and r.n_pieces == len(r.ids)
    uses = {}
    for r in got:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
    assert max(uses.values()) == 2 and p.ORACLE_SQL is None


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, "")
        assert out.count() == 0
        if k < 4:
            assert out.columns == docs.columns


def test_last_stage_decodes_every_row(spark, library):
    texts = ["ka to schung", "  two  spaces ", "tab\tand\nline", "\ufb01ne \u2460", "", None, "\U0001f600 x"]
    docs = spark.createDataFrame([(i, t, "xx", "src0", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    name, stage = p.STAGES[-1]
    got = {r.doc_id: r for r in stage(spark, docs, "").collect()}
    assert "decoding" in name and set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i].round_trip == (t is None or library.decode(library.encode(t)) == t)
    assert got[0].round_trip


def test_batches_of_stages_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "repeat('ab cd ', 500) as text", "'xx' as lang", "'src0' as source", "3000L as n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    try:
        for _, stage in p.STAGES[2:4]:
            spark.conf.unset(key)
            stage(spark, docs.limit(5), "")
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 1.1 * p.BATCH_BYTES
    finally:
        spark.conf.set(key, before)

import random

import pytest

from tidemark.llm.queries import TOKENIZERS
from tidemark.llm.sentencepiece import MARK, Encoder, Vocabulary, decode, encode, encode_and_check

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(7)
    out = ["", " ", "  ", "a", "Hello  world\n\n foo  \tbar ", "\n", "x▁y", "ééé ßtraße 日本語 \U0001f600 á", "a" * 3000, " " * 301, "\r\n;\r\n{\r\n", "\x00\x01"]
    alphabet = ["the", "tion", "ing", "er", "a", "e", "n", "s", " ", " ", " ", "\n", ",", ".", "é", "ß", "ch", "Un", "1", "99", "_", "(", "  ", "\t", "ü", "Z", "zz", "ll", "ui", "日", "\U0001f600"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    return out


def test_equals_the_library(library):
    encoder = Encoder(open(PATH, "rb").read())
    all_texts = texts()
    for k in range(0, len(all_texts), 50):
        part = all_texts[k : k + 50]
        counts, ids = encoder.encode(part)
        at = 0
        for t, n in zip(part, counts.tolist(), strict=True):
            own = ids[at : at + n].tolist()
            at += n
            assert own == library.encode(t)
            assert encoder.decode(own) == library.decode(own)


def test_corpus_words(library, spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    counts, ids = Encoder(open(PATH, "rb").read()).encode(rows)
    assert ids.tolist() == [k for own in library.encode(rows) for k in own]


def test_unigram_viterbi_against_all_segmentations():
    v = Vocabulary(open(PATH, "rb").read())
    v.bpe = False
    v.ids = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "abb", MARK, MARK + "a"])}
    v.pieces, v.scores = list(v.ids), [-2.0, -2.5, -3.1, -3.3, -4.2, -1.0, -2.4]
    v.prefixes = {p[:k] for p in v.ids for k in range(len(p) + 1)}
    v.least = -20.0
    v.width = [len(p) for p in v.pieces] + [1]

    def best(w):
        if not w:
            return 0.0
        options = [v.scores[k] + best(w[len(p) :]) for p, k in v.ids.items() if w.startswith(p)]
        return max(options + [v.least + best(w[1:])])

    rng = random.Random(2)
    words = sorted({MARK + "".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(80)})
    for w, ids in zip(words, v.encode_sorted(words), strict=True):
        assert abs(sum(v.scores[k] if k >= 0 else v.least for k in ids) - best(w)) < 1e-9
        assert "".join(v.pieces[k] if k >= 0 else "c" for k in ids) == w


def test_frames(spark):
    rows = [(1, "a b", 5), (2, None, 6), (None, "", 7), (4, "z" * 200_000 + " end", 8)]
    out = decode(encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = {r.doc_id: (r.ids, r.text, r.decoded) for r in out.collect()}
    assert got[2] == (None, None, None) and got[None] == ([], "", "")
    assert all(t == d for _, t, d in got.values())
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_pieces_fit_as_merging_says():
    v = Vocabulary(open(PATH, "rb").read())
    rng = random.Random(4)
    ids = [i for p, i in v.ids.items() if MARK * 2 not in p]
    short = [i for i in ids if len(v.pieces[i]) < 4]
    pairs = [(rng.choice(a), rng.choice(b)) for a, b in ((ids, ids), (short, short), (short, ids)) for _ in range(15_000)]
    pairs += [(v.ids[p[:k]], v.ids[p[k:]]) for p in rng.sample(list(v.ids), 6000) for k in range(1, len(p)) if p[:k] in v.ids and p[k:] in v.ids]
    for left, right in pairs:
        both = v.pieces[left] + v.pieces[right]
        if MARK not in both[1:]:
            assert v.fits(left, right) == (v.merge(both) == [left, right]), both


def test_query_against_the_library(library, spark):
    import hashlib

    from tidemark.llm.queries import op9_pieces

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op9_pieces(spark, d).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = library.encode(t or "")
        assert got[k].n_pieces == len(ids) and got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].round_trip == (library.decode(ids) == t)


def test_encode_and_check(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (2, None, 6), (3, "", 7), (4, "nul \x00 \ue000", 8)]
    out = encode_and_check(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH)
    assert out.columns == ["doc_id", "ids", "round_trip"]
    got = out.collect()
    assert len(got) == 5 and {r.doc_id: r.ids for r in got}[2] is None and all(r.round_trip for r in got)
    alone = encode_and_check(spark.createDataFrame([("x",), (None,)], "text string"), PATH)
    assert alone.columns == ["ids", "round_trip"] and alone.count() == 2

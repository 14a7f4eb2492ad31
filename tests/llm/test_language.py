import random

from tidemark.llm.language import STRETCH, Model, automaton, predict_language, training_texts


def parse(text, corpus):
    """Greedy cross-parsing by substring search, in the same stretches."""
    total = 0
    for a in range(0, len(text), STRETCH):
        piece, i, n = text[a : a + STRETCH], 0, 0
        while i < len(piece):
            j = i
            while j < len(piece) and piece[i : j + 1] in corpus:
                j += 1
            i, n = max(j, i + 1), n + 1
        total += n
    return total


def test_phrases_against_substring_search():
    rng = random.Random(1)
    corpora = [("x", "".join(rng.choice("abcd ") for _ in range(900))), ("y", "".join(rng.choice("abce ") for _ in range(700)))]
    corpora = [(k, " ".join(t.split())) for k, t in corpora]
    model = Model(corpora)
    texts = [" ".join("".join(rng.choice("abcdezq ") for _ in range(rng.randint(1, 1500))).split()) for _ in range(40)] + [""]
    counts, size = model.phrases(texts)
    for k, t in enumerate(texts):
        assert size[k] == len(t)
        for j, (_, c) in enumerate(corpora):
            # an unseen character is a phrase of its own and starts the next at the root, as in the plain parse but for the first
            assert abs(counts[k, j] - parse(t, c)) <= t.count("z") + t.count("q") + t.count("e") + t.count("d") + len(t) // STRETCH + 1
            if not set(t) & set("zqed"):
                assert counts[k, j] == parse(t, c)
    assert automaton("", {}, 2).size == 2


def test_predicts_and_rejects(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["schu", "ver", "ein", "ung"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    train = spark.createDataFrame([(i, text(k, 60), k) for k in ("aa", "bb") for i in range(30)] + [(99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string")
    rows = [(i, text(k, 1 + i * 3), k) for i, k in enumerate(["aa", "bb"] * 20)]
    rows += [(100, None, "und"), (101, "", "und"), (102, "12 34 !! \n", "und"), (None, text("aa", 9), "aa"), (103, text("bb", 60_000).upper(), "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = predict_language(docs, train).collect()
    want = {i: k for i, _, k in rows}
    assert len(out) == len(rows)
    assert all(r.lang_pred == want[r.doc_id] and 0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in predict_language(docs, train.limit(0)).collect()} == {"und"}
    assert predict_language(docs.limit(0), train).count() == 0


def test_a_long_document_leaves_room_for_the_others(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0))
    long = " ".join(f"long{name(i)}" for i in range(4000))
    rows = [(0, long, "xx")] + [(i, f"short{name(i)} text of its own", "xx") for i in range(1, 30)]
    ((lang, text),) = training_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=2000, docs=1000)
    assert lang == "xx" and 1900 < len(text) <= 2000
    assert sum(f"short{name(i)} text of its own" in text for i in range(1, 30)) > 20
    # of the long one, pieces of its beginning, middle and end
    own = [k for k in range(4000) if f" long{name(k)} " in text]
    assert min(own) < 100 and max(own) > 3900 and any(1500 < x < 2500 for x in own)


def test_every_labelled_language_is_learnt(spark):
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 70)]
    rows = [(k * 4 + j, f"{a * (3 + j)} {a}{a} ", f"l{k:02d}") for k, a in enumerate(alphabet) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(f"l{k:02d}", a * 5) for k, a in enumerate(alphabet)], "want string, text string")
    got = predict_language(asked, df).collect()
    assert {r.lang_pred for r in got} == {f"l{k:02d}" for k in range(70)} and all(r.want == r.lang_pred for r in got)


def test_repeated_labelled_rows_are_one(spark):
    rows = [(1, "abc " * 20, "x")] * 500 + [(1, "abd " * 20, "x"), (2, "xyz " * 20, "y"), (None, "qqq " * 50, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [k for k, _ in training_texts(df)] == ["x", "y"] and training_texts(df) == training_texts(df.orderBy("text", ascending=False))

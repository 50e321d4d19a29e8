import random

import pytest

from tidemark.llm import rlz_dedup


def plain(texts, least):
    """(number of words, words that are left) of each text, by a dictionary of all windows."""
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for r, w in enumerate(words):
        for s in range(len(w) - least + 1):
            seen.setdefault(tuple(w[s : s + least]), []).append((r, s))
    gone = [set() for _ in words]
    for places in seen.values():
        for r, s in places if len(places) > 1 else ():
            gone[r].update(range(s, s + least))
    return [(len(w), b" ".join(x for k, x in enumerate(w) if k not in g).decode()) for w, g in zip(words, gone, strict=True)]


def some_texts(seed, least):
    """Texts of few words, with passages around the least length that several share, one of them in every third text."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "dd", "é x", "e"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (least - 1, least, least + 1, 2 * least, 3 * least + 5)]
    common = [word() for _ in range(least - 2)]
    texts = []
    for i in range(90):
        text = [word() for _ in range(rng.randrange(3 * least))]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            cut = rng.randrange(3)
            text += p[cut:] if rng.random() < 0.5 else p
        text += common if i % 3 == 0 else []
        text += [word() for _ in range(rng.randrange(least))]
        texts.append(rng.choice([" ", "\n", " \t\x0b\r\n"]).join(text))
    return texts + texts[:5] + [None, "", " \n", "one " * (4 * least), " ".join(passages[3] * 2)]


@pytest.mark.parametrize(("least", "gram", "hot", "words"), [(6, 3, 1 << 14, 400_000), (6, 3, 1 << 14, 300), (6, 2, 5, 300), (35, 8, 1 << 14, 400_000), (9, 9, 20, 1000)])
def test_equals_all_windows(spark, least, gram, hot, words):
    texts = some_texts(least + gram, least)
    docs = spark.createDataFrame([(i if i % 7 else None, i, t, "x") for i, t in enumerate(texts)], "doc_id long, at long, text string, t1 string")
    got = rlz_dedup.drop_repeated(docs, least=least, gram=gram, hot=hot, block_words=words).orderBy("at").collect()
    assert [(r["n_words"], r["kept"]) for r in got] == plain(texts, least)
    assert all(r["n_removed"] == r["n_words"] - len((r["kept"] or "").split(" ") if r["kept"] else []) for r in got)
    assert {r["t1"] for r in got} == {"x"}


def test_odd_rows(spark, docs, no_docs):
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in rlz_dedup.drop_repeated(docs).collect()), key=str)
    long = "lorem ipsum dolor sit amet " * 20_000
    want = [(0, 6, 0), (1, 17, 0), (1, 17, 0), (2, 17, 0), (3, 0, 0), (4, 0, 0), (5, len(long.split()), len(long.split())), (6, 0, 0)]
    assert got == sorted(want, key=str)
    assert rlz_dedup.drop_repeated(no_docs).count() == 0
    clash = rlz_dedup.drop_repeated(docs.withColumnRenamed("lang", "kept").withColumnRenamed("ids", "N_words"))
    assert sorted(clash.columns) == sorted(["doc_id", "th", "score", "n_words", "n_removed", "kept"])


def test_factors_of_a_block():
    """A window that two factors share is found at their boundary: 'b c' follows 'a' here and 'd' there."""
    block = rlz_dedup.Block([w.encode().split() for w in ("x a b c d y", "p a b c q", "r b c d s")])
    spans = sorted(zip(*(v.tolist() for v in block.repeated(3)), strict=True))
    assert {(r, k) for r, b, e in spans for k in range(b, e)} == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)}

"""Language identification: one parse over blocks, any number of languages and letters, awkward rows."""

import random

import pytest

from bizfit.llm import language_id as L


def plain_pieces(sample, text):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


@pytest.mark.parametrize("block", [3, 7, 50, 2048])
def test_blocks_do_not_change_the_count(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rng = random.Random(block)
    prose = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))) for _ in range(n))
    samples = {"x": [prose(200)], "y": [prose(200)]}
    model = L.Model(samples)
    # the last ones repeat the sample, so that a piece is longer than many blocks
    texts = [prose(150), prose(3) + "zz" + prose(40), "a", samples["x"][0], samples["y"][0][10:400] + prose(30), samples["x"][0] + samples["y"][0]]
    got = model.pieces([model.symbols(L.letters(t)) for t in texts])
    for n, lang in enumerate("xy"):
        sample = samples[lang][0] + " "
        assert got[:, n].tolist() == [plain_pieces(sample, t) for t in texts]


def test_many_languages_and_letters(spark):
    rng = random.Random(1)
    alphabet = {f"l{k:03}": [chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(130)}
    words = {lang: ["".join(rng.choice(a) for _ in range(4)) for _ in range(4)] for lang, a in alphabet.items()}
    prose = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(30))
    rows = [(6 * k + j, prose(lang), lang) for k, lang in enumerate(alphabet) for j in range(6)]
    out = {r["doc_id"]: r["lang_pred"] for r in L.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learned = {lang for i, _, lang in rows if __import__("zlib").crc32(str(i).encode()) % 3 != 1}
    assert len(learned) > 120
    assert all(out[i] == lang for i, _, lang in rows if lang in learned)


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, score double, mark long"
    rows = [(k, "the cat sat" if k % 2 else "le chat est", "en" if k % 2 else "fr", None, None, None) for k in range(40)]
    rows += [(None, "the cat", "en", "x", 1.0, 1), (50, None, "en", None, None, None), (51, "", None, None, None, None), (52, "the cat " * 20_000, None, None, None, None)]
    rows += [(53, "the cat", None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, schema)
    out = L.language_id(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[50]["lang_pred"] == by[51]["lang_pred"] == "und" and by[50]["score"] == 0 and by[52]["lang_pred"] == by[53]["lang_pred"] == by[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out)
    kept = L.keep_identified(docs, L.learn(docs))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    # equal samples cost the same: the first name wins
    assert L.Model({"b": ["same text"], "a": ["same text"]}).predict(["same text"])[0] == ["a"]
    # nothing to learn from
    assert {r["lang_pred"] for r in L.language_id(docs.withColumn("lang", docs["lang_pred"].cast("string")).filter("lang IS NULL")).collect()} == {"und"}
    assert L.language_id(docs.limit(0)).count() == 0

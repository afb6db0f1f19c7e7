import random
import zlib

import duckdb
import numpy as np

from colloquy.llm import langid, toxicity
from colloquy.llm.queries import op2_language, op4_toxicity

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    rows = op2_language(spark, SF).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held)
    assert right > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, t, l, "s") for i, (t, l) in enumerate([("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de"), (None, "en"), ("", "de"), ("12 34 !?", "en"), ("le chat", None)] * 4)], "doc_id long, text string, lang string, score string")
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    got = [(r["text"], r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()]
    assert len(got) == 24
    for text, lang, score in got:
        if text in (None, "", "12 34 !?"):
            assert (lang, score) == ("und", 0)
        elif text.startswith("the"):
            assert lang == "en"
        elif text.startswith("der"):
            assert lang == "de"
    nothing = langid.train(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    long = spark.createDataFrame([("der hund und die katze " * 100_000,)], "text string")
    assert langid.identify(long, model).first()["lang_pred"] == "de"


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        c = langid.codewords(n)
        apart = ((c[:, None] != c[None]).sum(2) + np.eye(n, dtype=int) * 99).min()
        assert apart >= (2 ** (n - 2) if n <= 7 else c.shape[1] // 4)


def test_toxicity_held_out(spark):
    rows = op4_toxicity(spark, "/root/testdata/sf0.1").select("doc_id", "held_out", "score", "predicted").collect()
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.1/labels.parquet'").fetchall())
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    hit = sum(p and t for _, p, t in held)
    assert hit / sum(t for *_, t in held) > 0.75 and hit / sum(p for _, p, _ in held) > 0.8


def toy():
    rng = random.Random(0)
    plain = ["the", "water", "house", "reading", "silent", "garden", "idea", "stupendous", "moronga", "window"] + ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts, toxic = [], []
    for i in range(300):
        w = [rng.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            for bad in rng.sample(["stupid", "moron", "idiot"], 2):
                w.insert(rng.randrange(40), bad)
        texts.append(" ".join(w) + ".")
        toxic.append(int(i % 5 == 0))
    return texts, toxic, " ".join(plain[:8])


def test_gapped_insults():
    texts, toxic, calm = toy()
    model = toxicity.fit(texts, toxic)
    margin = dict(zip(words := ["stupid", "stuxpid", "idiot", "iddiot", "moron", "water", "stupendous", "garden"], model.margins(words), strict=True))
    assert min(margin[w] for w in ("stupid", "idiot", "moron", "stuxpid", "iddiot")) > max(margin[w] for w in ("water", "garden", "stupendous"))
    assert "idiot" in {toxicity.plain(w) for w in toxicity.words_of("you i d i o t!")} and toxicity.plain("1d-i0t") == "idiot" and toxicity.plain("123") == ""


def test_insults_split_by_spaces_signs_and_letters():
    texts, toxic, calm = toy()
    rng = random.Random(5)
    common = "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出就分对成会可主发年动同工也能下过子说产种面而方后多定行学法所"
    for i in range(200):
        w = [rng.choice(common) for _ in range(60)]
        if i % 5 == 0:
            w.insert(rng.randrange(60), "傻逼")
        texts.append("".join(w) + "。")
        toxic.append(int(i % 5 == 0))
    model = toxicity.fit(texts, toxic)

    def score(insult):
        return model.score([v for v, _ in model.finds([f"{calm} {insult} the water."])[0]])

    for insult in ("stupid", "STUPID", "5tup1d", "s-t-u-p-i-d", "stu pid", "s, t, u, p, i, d", "s.t.u.p.i.d", "mo-ron", "大为上个国傻逼我以要"):
        assert score(insult) >= 0.3, insult
    for word in ("stupendous", "reading", "大为上个国我以要", "st. Upon"):
        assert score(word) < 0.3, word
    # With letters put in throughout it stands far above clean words, but below the cut.
    assert score("stxuxpxid") > 4 * max(score("reading"), score("stupendous"))


def test_windows_of_texts_by_hand():
    texts, toxic, _ = toy()
    model = toxicity.fit(texts, toxic)
    rng = random.Random(3)

    def by_hand(text):
        found = []
        for line in text.lower().split("\n"):
            words = line.split(" ")
            for a in range(len(words)):
                for m in range(1, toxicity.RUN + 1):
                    run = words[a : a + m]
                    if len(run) == m and len(" ".join(run)) + 2 <= toxicity.WIDTH:
                        found.append((model.margins([" ".join(run)])[0], model.margins(run).max(), m, " ".join(run)))
        return max((v, w) for v, inside, m, w in found if v > toxicity.FLOOR and (m == 1 or v > inside + toxicity.GAIN))

    for _ in range(20):
        text = "".join(rng.choice(["stu", "pid", "idi", "ot", "mo", "ron", "water", "w"]) + rng.choice("  \n ") for _ in range(12)).strip()
        text = "\n".join(" ".join(line.split()) for line in text.split("\n") if line.strip())
        value, window = by_hand(text)
        got = model.finds([text])[0][0]
        assert abs(got[0] - value) < 1e-4 and (got[1] == window or abs(model.margins([got[1]])[0] - value) < 1e-4)


def test_long_texts_come_in_pieces():
    texts, toxic, calm = toy()
    model = toxicity.fit(texts, toxic)
    for unit in (calm + " ", calm.replace(" ", "")):
        text = unit * (3 * toxicity.PIECE // len(unit))
        assert all(len(p) <= toxicity.PIECE for p in toxicity.pieces(text))
        clean = model.finds([text])[0]
        for at in (toxicity.PIECE - 3, toxicity.PIECE - len(unit), 2 * toxicity.PIECE - 30, len(text)):
            at = text.rfind(" ", 0, at) + 1 if " " in text else at
            found = model.finds([text[:at] + " stu pid " + text[at:]])[0]
            assert found[0][1] == "stu pid" and found[0] not in clean
    assert [list(toxicity.pieces(t)) for t in ("", "a b")] == [[""], ["a b"]]
    assert model.finds([None, "", "12 !?", "\n"]) == [[], [], [], []]


def test_kernel_by_hand():
    def k(a, b):
        def f(w):
            w = "\x1f" + w + "\x1f"
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for m in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        out[w[i] + w[j] + w[m]] = max(out.get(w[i] + w[j] + w[m], 0), toxicity.DECAY ** (m - i - 2))
            n = sum(v * v for v in out.values()) ** 0.5
            return {t: v / n for t, v in out.items()}

        x, y = f(a), f(b)
        return sum(v * y.get(t, 0) for t, v in x.items())

    words = ["idiot", "idxiot", "stupid", "abc", "ab"]
    got = toxicity.kernel(words, toxicity._table(words))
    assert np.allclose(got, [[k(a, b) for b in words] for a in words], atol=0.02)


def test_toxicity_edges(spark):
    texts, toxic, calm = toy()
    model = toxicity.fit(texts, toxic)
    rows = [(1, calm, "a"), (2, None, "b"), (3, "", "c"), (4, "!!! 12", "d"), (5, calm + " moron idiot stupid", "e"), (5, calm + " moron idiot stupid", "e"), (6, (calm + " ") * 5000 + "moron idiot", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted((r["doc_id"], r["predicted"]) for r in toxicity.score_texts(df, model).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (5, 1), (6, 1)]
    assert toxicity.score_texts(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic long")
    assert {r["predicted"] for r in toxicity.score_texts(df, toxicity.train(df, labels)).collect()} == {0}
    assert {r["predicted"] for r in toxicity.score_texts(df, toxicity.train(df, labels.limit(0))).collect()} == {0}

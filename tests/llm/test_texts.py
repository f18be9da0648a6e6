"""Token ids, leaks and garbled text: against the plain encoder, brute force, and held-out garbling."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from runefold.llm import fmindex, garbled, leaks, tokens

TEXTS = "doc_id long, text string, ids string, item_id string"


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read())


def test_chunked_ids_equal_those_of_whole_texts(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CUT_BITS", 4)  # many joins
    monkeypatch.setattr(tokens, "LONGEST", 100)
    r = random.Random(2)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "'", "l", "ll", "'re", "a", "Zebra", "9", "日本", "é", "e\u0301", "!", "\x1c", "\x85", "\u200b", "😀", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(300))) for _ in range(800)] + ["Q" * 5000, " " * 3000 + "x", "ab " * 2000, "", None]
    got = tokens.encode_slice(encoder, pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [encoder.core.encode_ordinary(t) if t else [] for t in texts]


def test_shared_chunks_are_encoded_once(encoder):
    body = " ".join(f"word{i}" for i in range(4000))
    before = encoder.encoded
    tokens.encode_slice(encoder, pa.array([body]))
    once = encoder.encoded - before
    tokens.encode_slice(encoder, pa.array(["another start " + body, body + " and end"]))
    assert once > 10 and encoder.encoded - before < once + 8


def test_chunks_of_several_partitions_are_encoded_once(spark, encoder, tmp_path):
    r = random.Random(6)
    words = ["alpha", "Beta", "naïve", "x1", "日本", "  ", "\n\n", "don't"]
    body = [" ".join(r.choice(words) + str(r.randrange(50)) for _ in range(1500)) for _ in range(6)]
    rows = [(n, f"start {n} " + r.choice(body) + f" middle {n} " + body[0], "", "") for n in range(40)]
    docs = spark.createDataFrame(rows, TEXTS).repartition(5).persist()
    with open(tokens.VOCABULARY, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    folder = tokens.shared_chunks(docs, "text", vocabulary, f"file://{tmp_path}/chunks")
    given, keys = spark.read.parquet(folder), spark.read.parquet(f"file://{tmp_path}/chunks/keys")
    several = keys.groupBy("h").count().where("count > 1").count()
    owned = spark.read.parquet(f"file://{tmp_path}/chunks/owned")
    assert owned.count() == owned.select("h").distinct().count() == several > 20
    assert given.select("h").distinct().count() > 0.9 * several and given.groupBy("h", "p").count().where("count > 1").count() == 0
    got = {x["doc_id"]: x["ids"] for x in tokens.token_ids(docs).collect()}
    assert got == {n: encoder.core.encode_ordinary(t) for n, t, *_ in rows}
    encoder.given = tokens.Given(folder, 0)
    encoder.young, encoder.old, encoder.received = {}, {}, 0
    assert encoder.document(rows[0][1].encode(), tokens.cut_places(np.frombuffer(rows[0][1].encode(), np.uint8)).tolist()).tolist() == got[0]
    assert encoder.received > 2
    wrong = pa.array([b"\x01\x00\x00\x00"] * len(encoder.given.at), pa.binary())
    encoder.given.codes, encoder.young, encoder.old = wrong, {}, {}  # ids of another chunk are not believed
    assert encoder.document(rows[0][1].encode(), tokens.cut_places(np.frombuffer(rows[0][1].encode(), np.uint8)).tolist()).tolist() == got[0]
    encoder.given = None
    docs.unpersist()


def test_joins_that_do_not_agree_are_encoded_anew(encoder, monkeypatch):
    text = " ".join(f"word{i}" for i in range(2000))
    cuts = tokens.cut_places(np.frombuffer(text.encode(), np.uint8)).tolist()
    made = encoder.made

    def spoiled(data):
        c = made(data)
        return c and c._replace(ids=np.concatenate([c.ids[:1] + 1, c.ids[1:]]))

    monkeypatch.setattr(encoder, "made", spoiled)
    encoder.young, encoder.old = {}, {}
    assert encoder.document(text.encode(), cuts).tolist() == encoder.core.encode_ordinary(text)
    encoder.young, encoder.old = {}, {}


def test_very_long_runs_of_blanks(encoder):
    text = " " * 600_000 + "x"
    ids = tokens.encode_slice(encoder, pa.array([text]))[0]
    assert encoder.core.decode_bytes(ids.tolist()).decode() == text


def test_token_ids_table(spark, encoder):
    rows = [(1, "Hello  world", "x", "y"), (2, None, None, None), (3, "", "a", "b"), (None, "x", "", ""), (1, "Hello  world", "x", "y")]
    got = [(r["doc_id"], r["ids"]) for r in tokens.token_ids(spark.createDataFrame(rows, TEXTS)).collect()]
    assert sorted(map(str, got)) == sorted(str((d, encoder.core.encode_ordinary(t) if t else [])) for d, t, *_ in rows)
    assert tokens.token_ids(spark.createDataFrame([], TEXTS)).count() == 0


# Leaks


@pytest.mark.parametrize(("n", "top"), [(1, 3), (60, 2), (700, 4), (3000, 300)])
def test_index_finds_what_a_scan_finds(n, top):
    r = np.random.default_rng(n)
    text = r.integers(0, top + 1, n).astype(np.int64)
    if n >= 700:
        text[400:700] = text[100:400]
    index, phrases = fmindex.FMIndex(text, top), []
    for _ in range(150):
        i, k = r.integers(0, n), r.integers(1, 7)
        p = text[i : i + k]
        p = r.integers(1, top + 1, k) if (p == 0).any() or r.random() < 0.2 else p
        phrases.append(np.concatenate([p, np.zeros(8 - len(p), np.int64)]))
    for p, low, high in zip(phrases, *index.find(np.array(phrases))):
        p = p[p > 0]
        want = [i for i in range(n - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def item(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "mill"]) if r.random() < 0.3 else "".join(r.choice("bdklmnorstu") + r.choice("aeiou") for _ in range(3)) for _ in range(n))


ITEM_A, ITEM_B, ITEM_C = item(1), item(2), "Café naïve " + item(3)


def replaced(text, every, seed=0):
    w = text.split()
    for i in range(every - 1, len(w), every):
        w[i] = f"other{i + seed}"
    return " ".join(w)


def passage(text, n, at=30):
    return " ".join(text.split()[at : at + n])


CASES = {
    "full": (ITEM_A, True),
    "wrapped and marked": ("# " + "\n# ".join(ITEM_A.upper().replace(" mill", " **mill**,").split("  ")) + "</p>", True),
    "json": ('{"source": ["' + '\\n",\n "'.join([ITEM_A[:200], ITEM_A[200:]]).replace("a", "\\u0061", 9) + '"]}', None),
    "escaped": ('["' + ITEM_A.replace(" of ", '\\n",\n    "of ').replace("e", "\\u0065") + '"]', True),
    "invisible": (ITEM_A.replace("o", "o\u200b").replace(" mill", "\u00a0mi\u00adll"), True),
    "tags": (ITEM_A.replace(" the ", " <b class='x'>the</b> "), True),
    "one in eight": (replaced(ITEM_A, 8), True),
    "one in six": (replaced(ITEM_A, 6), False),
    "twenty": ("before " + passage(ITEM_A, 20) + " after", True),
    "nineteen": ("before " + passage(ITEM_A, 19) + " after", False),
    "twice ten": (passage(ITEM_A, 10) + " xx yy " + passage(ITEM_A, 10, 40), False),
    "nothing": ("plain text about mills", False),
}


@pytest.mark.parametrize("name", [k for k, v in CASES.items() if v[1] is not None])
def test_leak_cases(name):
    text, want = CASES[name]
    test = leaks.TestSet([(1, ITEM_A), (2, ITEM_B), (3, ITEM_C)])
    w = [leaks.words(x) for x in ("noise " + text + " tail", "unrelated", text)]
    symbols = [np.array([test.vocabulary.get(x, 0) for x in d], np.int64) for d in w]
    found = leaks.search_shard(test, np.concatenate(symbols), np.concatenate([[0], np.cumsum([len(s) for s in symbols])]))
    assert {(d, test.items[i].id) for d, i, _, _ in found} == ({(0, 1), (2, 1)} if want else set())


def test_leaks_on_tables(spark):
    docs = [(1, "x " + ITEM_A, "", ""), (2, None, None, None), (3, "", "", ""), (4, ITEM_C.replace("é", "e\u0301") + " " + ITEM_B, "", ""), (None, ITEM_B, "", ""), (6, "!?", "", "")]
    items = [(10, ITEM_A), (11, ITEM_B), (12, ITEM_C), (13, None), (None, ITEM_A), (14, ""), (15, ITEM_A)]
    d, i = spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id int, text string")
    got = {tuple(r) for r in leaks.leaked(d, i).collect()}
    assert got == {(1, 10), (1, 15), (4, 11), (4, 12), (None, 11)}
    assert leaks.leaked(d.limit(0), i).count() == 0 and leaks.leaked(d, i.limit(0)).count() == 0
    spans = {r["doc_id"]: r for r in leaks.removal_spans(d, i).collect()}
    assert docs[0][1][spans[1]["start"] : spans[1]["stop"]] == ITEM_A and spans[1]["n_items"] == 2
    assert spans[4]["start"] == 0 and spans[4]["stop"] == len(docs[3][1])


def test_removal_spans_are_whole(spark):
    w = replaced(ITEM_A, 8).split()
    cleaner = " ".join(ITEM_A.split()[:30] + w[30:])  # a run of 30 words, then one word in eight replaced
    docs = [(1, f"alpha {replaced(ITEM_A, 8)} {'beta ' * 60}{replaced(ITEM_A, 8, 7)} gamma", "", ""), (2, f"alpha {cleaner} beta", "", ""), (3, f"alpha {passage(ITEM_A, 20)} {'beta ' * 60}{replaced(ITEM_A, 8)} gamma", "", "")]
    d, i = spark.createDataFrame(docs, TEXTS), spark.createDataFrame([(10, ITEM_A), (11, ITEM_B)], "item_id int, text string")
    left = {n: text for n, text, *_ in docs}
    for r in leaks.removal_spans(d, i).orderBy(leaks.F.desc("start")).collect():
        left[r["doc_id"]] = left[r["doc_id"]][: r["start"]] + left[r["doc_id"]][r["stop"] :]
    assert {n: " ".join(dict.fromkeys(t.split())) for n, t in left.items()} == {1: "alpha beta gamma", 2: "alpha beta", 3: "alpha beta gamma"}
    assert {tuple(r) for r in leaks.leaked(d, i).collect()} == {(1, 10), (2, 10), (3, 10)}


def test_tags_of_any_length_are_no_words():
    image = "<img alt='a chart'\n src=\"data:image/png;base64," + "iVBORw0KGgo+/A9z" * 60 + '" width=10/>'
    w = replaced(ITEM_A, 8).split()
    for tag in (image, image.replace('"', '\\"').replace("\n", "\\n"), '<div style="' + "margin: 1px; " * 40 + '">', "<p\n class='x'>"):
        assert leaks.words(f"one {tag} two") == ["one", "two"]
        assert "".join(leaks.blank_markup(tag).split()) == "" and len(leaks.blank_markup(tag)) == len(tag)
    test = leaks.TestSet([(1, ITEM_A)])
    symbols = np.array([test.vocabulary.get(x, 0) for x in leaks.words(" ".join([*w[:60], image, *w[60:]]))], np.int64)
    assert leaks.search_shard(test, symbols, np.array([0, len(symbols)]))
    for prose in ("if a <b and c\n> d", "<img alt='" + ITEM_A + "' src='x'>"):
        assert len(leaks.words(prose)) > 4


@pytest.mark.parametrize("size", [290, 310, 1990, 2100, 100_000])
def test_markup_of_any_length_hides_no_passage(spark, size):
    w = passage(ITEM_A, 21).split()
    docs = [(n, " ".join([*w[:10], middle, *w[10:]]), "", "") for n, middle in enumerate(("<div " + "x" * size + ">", "<!-- " + "x y " * (size // 4) + "-->", "<i\n" + "a b\n" * (size // 4) + ">"))]
    docs.append((3, "if a <b then " + ITEM_B + " " + "c " * size + "> d", "", ""))  # no tag: the passage stands between two signs
    docs.append((4, "<!-- <p " * 2000 + ITEM_B + " <!-- " * 2000, "", ""))
    i = spark.createDataFrame([(10, ITEM_A), (11, ITEM_B)], "item_id int, text string")
    assert {tuple(r) for r in leaks.leaked(spark.createDataFrame(docs, TEXTS), i).collect()} == {(0, 10), (1, 10), (2, 10), (3, 11), (4, 11)}


def test_items_in_blocks_and_passes(spark, monkeypatch):
    items = [(n, item(n)) for n in range(20, 50)]
    docs = [(n, f"x {replaced(t, 8)} y {items[(n + 1) % 30][1]}", "", "") for n, t in items]
    d, i = spark.createDataFrame(docs, TEXTS), spark.createDataFrame(items, "item_id int, text string")
    want = sorted(map(tuple, leaks.leaked(d, i).collect()))
    spans = sorted(map(tuple, leaks.removal_spans(d, i).collect()))
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 2500)
    assert sorted(map(tuple, leaks.leaked(d, i).collect())) == want and len(want) == 60
    monkeypatch.setattr(leaks, "MOST_WORDS", 300)
    assert len(leaks._passes(i, "item_id", "text")) > 3
    assert sorted(map(tuple, leaks.leaked(d, i).collect())) == want
    assert sorted((a, b, c) for a, b, c, _ in map(tuple, leaks.removal_spans(d, i).collect())) == [s[:3] for s in spans]


def test_common_length():
    r = random.Random(1)
    for _ in range(50):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 20))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert leaks.common_length(np.array(a), np.array(b)) == t[-1, -1]


# Garbled text

SENTENCES = [
    "Die Übung zeigt größere Flüsse und schöne Mühlen über dem Fährhaus",
    "Le modèle a été entraîné sur la série précédente, voilà pourquoi",
    "La estación más fría llegará después; ¿por qué ocurre así, señor?",
    "A solução não é difícil, então é preciso atenção à medição da maré",
    "Занятие показывает журнал мельницы за последний год",
    "Ćwiczenie pokazuje długość księgi łąk, później średnią",
    "Yalnızca düşük güneşli günler değişti, ağaç sayımı aşağıda",
    "They’re rounded — it’s the “rusty” half… about 20 °C",
]


@pytest.fixture(scope="module")
def model():
    r = random.Random(3)
    texts = []
    for _ in range(600):
        words = " ".join(r.choice(SENTENCES) for _ in range(3)).split()
        texts.append("plain words first. " + " ".join(words[r.randrange(5) : r.randrange(15, len(words))]))
    for _ in range(20):  # the sample is not clean
        texts.append(garbled.Chain("utf-8", "cp1252").garble(r.choice(SENTENCES)))
    return garbled.Classifier.fit(texts)


HELD_OUT = [
    ("utf-8", "latin-1", range(8)), ("utf-8", "cp1252", range(8)), ("utf-8", "mac_roman", (0, 1, 2, 3)), ("utf-8", "cp437", (0, 1, 2)), ("utf-8", "cp1251", (0, 1)),
    ("cp1252", "mac_roman", (0, 1, 2, 3)), ("cp866", "cp1251", (4,)), ("cp1251", "cp1252", (4,)), ("koi8-r", "cp1251", (4,)), ("cp1250", "cp1252", (5,)), ("cp1254", "cp1252", (6,)),
]


def test_documents_ask_for_all_words_that_decide(model):
    r = random.Random(9)
    chains = [c for c in garbled.CHAINS if c.true in ("cp1252", "cp1251", "koi8-r", "cp1250", "shift_jis") and not c.loss]
    for _ in range(60):
        parts = [(c.garble(x) if (c := r.choice(chains)) and r.random() < 0.7 else x) or x for x in r.choices(SENTENCES, k=3)]
        text, used = " clean words of some length stand between them ".join(parts) + "\n" + parts[0], set()
        model.vouched = (lambda w: used.add(garbled._hash(garbled.form(w).casefold())) or garbled.Classifier.vouched(model, w))
        try:
            found = model.passages(text)
        finally:
            del model.vouched
        asked = model.asked(text)
        assert used <= (asked or set()) and (asked is not None or not found)


@pytest.mark.parametrize("between", [" plain words that nobody has garbled stand here, in a row of more than eighty letters, ", " größere Flüsse über schöne Mühlen größere Flüsse über schöne Mühlen "])
def test_many_passages_in_a_line_take_linear_time(model, between):
    one = garbled.Chain("utf-8", "cp1252").garble("voilà entraîné")
    took = []
    for n in (100, 400):
        text = between.join([one] * n)
        model.passages(text[: len(one) + len(between)])
        began = time.process_time()
        found = model.passages(text)
        took.append(time.process_time() - began)
        assert len(found) == n
    assert took[1] < 8 * took[0] + 0.2 and took[1] < 2


def test_words_that_do_not_invert_split_a_passage(model):
    bad = garbled.Chain("utf-8", "cp1252").garble("voilà entraîné")
    text = f"{bad} Ω☃Ж {bad}"
    found = model.passages(text)
    assert "".join(text[a:b] for a, b, _, back in found if back) == bad * 2 and all("☃" not in text[a:b] for a, b, *_ in found)
    pieces = garbled.restore(text, garbled.line_words(text), garbled.Chain("utf-8", "cp1252"), np.array([5.0, 5.0, 1.0, 5.0, 5.0]))
    assert [back for *_, back in pieces] == ["voilà entraîné", None, "voilà entraîné"]
    assert garbled.restore("Ω☃Ж", [(0, 3)], garbled.Chain("utf-8", "cp1252")) is None


def test_held_out_chains_are_found_and_restored(model):
    tried = good = restored = 0
    for true, wrong, which in HELD_OUT:
        for i in which:
            words = SENTENCES[i].split()
            clean = " ".join([*words[2:], "and plain words,", *words[:3]])
            bad = garbled.Chain(true, wrong).garble(clean)
            if bad is None:
                continue
            tried += 1
            found = model.passages("Some English before. " + bad)
            good += bool(found)
            text, at = [], 0
            whole = "Some English before. " + bad
            for a, b, _, back in sorted(found, key=lambda f: f[:2]):
                text += [whole[at:a], whole[a:b] if back is None else back]
                at = b
            restored += "".join(text) + whole[at:] == "Some English before. " + clean
    assert tried > 30 and good == tried and restored >= 0.8 * tried


@pytest.mark.parametrize("originals", [0, 1, 40])
def test_garbled_copies_do_not_pass_for_clean_text(originals):
    bad = garbled.Chain("utf-8", "cp1252").garble(SENTENCES[2])
    clean = [f"{s} {i}" for i in range(10) for k, s in enumerate(SENTENCES) if k != 2]
    copies = ["same start. " + bad] * 20 + [f"{i} {bad} {i}" for i in range(20)]  # a third of the rows, as such and with other text beside
    own = garbled.Classifier.fit(clean + copies + [f"{SENTENCES[2]} {i}" for i in range(originals)])
    assert own.passages("x " + bad) and own.passages(copies[0]) and own.passages(copies[-1])
    assert not any(own.known(w) for w in bad.split() if not w.isascii())


def test_strict_passages_stand_whatever_their_characters(model):
    text = "příliš žluťoučký kůň úpěl ďábelské ódy"  # no such characters in the sample
    found = model.passages("x " + garbled.Chain("utf-8", "cp1252").garble(text))
    assert [back for *_, back in found] == [text]


def test_words_outside_of_the_sample_vouch(spark, model):
    text = "Größe der Blütenstäubchen, Mühlenflügel fürs Gänseblümchen"
    bad = garbled.Chain("cp1252", "mac_roman").garble(text)
    df = spark.createDataFrame([(i, f"{text} {i}", "", "") for i in range(3)] + [(i, bad, "", "") for i in range(3, 9)], TEXTS)
    usual, vocabulary = garbled.corpus(df, model)
    own = garbled.Classifier(model.table, model.clean, model.lexicon, usual, model.suspect, vocabulary)
    own.held = frozenset(r["h"] for r in vocabulary.collect())
    assert [back for *_, back in own.passages("plain words " + bad)] == [text]
    assert [back for *_, back in model.passages("plain words " + bad)] != [text]
    sampled = garbled.fit(df, sample=1)
    sampled.held = frozenset(r["h"] for r in sampled.vocabulary.collect())
    assert all(sampled.vouched(w) for w in text.split() if not w.isascii()) and not sampled.vouched("Bärlauch") and "ß" in sampled.usual


@pytest.mark.parametrize(("true", "wrong", "rounds", "which"), [("iso8859-2", "cp1252", 1, 5), ("iso8859-2", "latin-1", 1, 5), ("cp852", "cp1252", 1, 5), ("cp852", "latin-1", 1, 5), ("iso8859-5", "cp1252", 1, 4), ("mac_cyrillic", "cp1252", 1, 4), ("utf-8", "cp1250", 2, 2), ("utf-8", "cp1251", 2, 5)])
def test_further_chains_are_found_and_restored(model, true, wrong, rounds, which):
    bad = garbled.Chain(true, wrong, rounds).garble(SENTENCES[which])
    text, at = "", 0
    for a, b, _, back in sorted(model.passages(bad), key=lambda f: f[:2]):
        text, at = text + bad[at:a] + back, b
    assert text + bad[at:] == SENTENCES[which]


def test_lost_bytes_are_found_but_not_restored(model):
    bad = garbled.Chain("cp1252", "utf-8", 1, "replace").garble(SENTENCES[0])
    found = model.passages(bad)
    assert found and all(back is None for *_, back in found)


def test_clean_and_quoted_text_is_no_case(model):
    for s in SENTENCES:
        assert model.passages(s + "\n" + s.upper()) == []
    quoted = "Reading with the wrong codec turns `é` into `Ã©`.\nprint('é'.encode('utf-8').decode('latin-1'))\n# Ã©\n# ['Ã¼', 'â€™']\n"
    assert model.passages(quoted) == []
    assert model.passages(quoted + "La estaciÃ³n mÃ¡s frÃ\xada llegarÃ¡ despuÃ©s") != []
    assert model.passages("") == [] and model.passages("ascii only") == []


def test_long_passages_beside_code_that_decodes_are_no_quotations(model):
    bad = garbled.Chain("utf-8", "cp1252").garble(SENTENCES[4])
    assert [back for *_, back in model.passages("raw = open(name, 'rb').read().decode('utf-8')\n" + bad)] == [SENTENCES[4]]
    assert model.passages(f"print('{SENTENCES[4]}'.encode('utf-8').decode('cp1252'))\n" + bad) == []


def test_every_chain_inverts_what_it_garbles():
    for chain in garbled.CHAINS:
        for s in SENTENCES:
            bad = chain.garble(s)
            if bad is not None and not chain.loss:
                assert chain.invert(bad) == s, chain.name
            assert chain.garble_all([s, "x", s]) == [bad, chain.garble("x"), bad]


def test_garbled_tables(spark, model):
    bad = garbled.Chain("utf-8", "cp1252").garble(SENTENCES[2])
    rows = [(1, "a\n" + bad, None, None), (2, None, None, None), (3, "", None, None), (4, SENTENCES[2], None, None), (None, bad, None, None), (1, "a\n" + bad, "x", "y")]
    df = spark.createDataFrame(rows, TEXTS)
    assert sorted(map(str, (r["doc_id"] for r in garbled.garbled(df, model).collect()))) == ["1", "1", "None"]
    out = garbled.garbled(df, model, restored=True).where("doc_id = 1").first()
    assert out["text"] == "a\n" + SENTENCES[2] and out["n_lost"] == 0 and out["chains"]
    empty = df.limit(0)
    assert garbled.garbled(empty, garbled.fit(empty)).count() == 0

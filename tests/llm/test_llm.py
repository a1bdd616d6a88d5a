import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import garbled, lookalike, mixing, reading, residue, styletree, tokens

BASE = "page_id long, url string, host string, html string, notes array<string>, status int, text string, why string"


# 1 look-alikes
def test_lookalikes(spark):
    b = [(1, 0, "Überblick im Haus", "x"), (1, 1, None, "x"), (1, 2, "", "x"), (1, 3, "ﬁx", "x"), (1, 4, "Haus", "x"), (1, 4, "Haus", "x"), (1, 5, "​", "x"), (2, 0, "Haus", "x"), (1, 6, "a" * 100_000, "x")]
    k = [(1, 0, "Überblick　im\xa0Hаus", "y"), (1, 1, "fix", "y"), (1, 2, "HAUS", "y"), (1, 3, "Haus", "y"), (1, 4, "Ｈａ​ｕｓ", "y"), (1, 5, None, "y"), (1, 6, "Häus", "y"), (1, 7, "‍", "y"), (1, 8, "ａ" + "a" * 99_999, "y")]
    blocks, links = spark.createDataFrame(b, "page_id long, block_id int, text string, canon string"), spark.createDataFrame(k, "page_id long, pos int, text string, canon string")
    got = {tuple(r) for r in lookalike.lookalike_pairs(blocks, links).collect()}
    assert got == {(1, 0, 0), (1, 3, 1), (1, 4, 4), (1, 6, 8)}
    assert lookalike.lookalike_pairs(blocks.limit(0), links).count() == 0


@pytest.mark.parametrize("a,b,same", [("𝐇aus", "Haus", True), ("ⅼist", "list", True), ("Ⅷ", "VIII", True), ("ｶﾞ", "ガ", True), ("H\U000e0061aus", "Haus", True), ("ᴏld", "old", True), ("ﬓ", "մն", True), ("Ꭺb", "Ab", True), ("x²", "x2", False), ("½", "1⁄2", False), ("①", "1", False), ("ſo", "so", False), ("a…", "a...", False)])
def test_compatibility_forms(a, b, same):
    import pyarrow as pa

    x, y = list(lookalike._normalise([pa.record_batch([pa.array([a, b])], ["canon"])]))[0].column(0).to_pylist()
    assert (x == y) is same


# 2 residue
PAD = "Ein Absatz über die Wohnung Nummer {} mit Garten, Küche und Blick auf den See, frei ab sofort und mit Keller."


def site(body, n=1):
    return f'<html><body><nav class="m"><a href="/">Start</a> <a href="/k">Kontakt</a></nav><main class="c">{body}</main><footer class="f"><p>Impressum und Datenschutz</p></footer></body></html>'


def test_residue(spark):
    good = [(i, "u", "h", site(f"<h1>Haus {i}</h1><p>{PAD.format(i)}</p>"), None, 200, "x", "y") for i in range(20)]
    odd = {
        100: (site("<h1>Not Found (502)</h1>"), None), 101: (site("<h1>Haus</h1><p>Lorem dolor sit mollit esse esse culpa</p>"), []), 102: (site(f"<h1>Haus</h1><dl><dt>Preis</dt><dd>{{{{ price }}}}</dd></dl><p>{PAD.format(1)}</p>"), []),
        103: (site('<div id="root"></div><noscript>Bitte aktivieren Sie JavaScript.</noscript>'), []), 104: (site('<div id="root"></div>'), ["body: Seite nicht gefunden"]), 105: (site("<p>Der Link fÃ¼hrt ins Leere.</p>"), []),
    }
    fine = {
        200: (site(f"<p>Meldet der Server 404, laden Sie neu.</p><p>{PAD.format(3)}</p>"), []), 201: (site("<p>Ruhig gelegen.</p>"), ["soft_404_suspected"]), 202: (site(f"<p>{PAD.format(4)}</p><pre>{{{{ price }}}}</pre>"), None),
        203: (site(f"<p>{PAD.format(5)}</p>") + "<script>var x='{{ y }}'</script>", None), 204: (None, ["body: Seite nicht gefunden"]), 205: (site('<div id="root"></div>'), ["thin_page"]), 206: ("", None), 207: (site("<p>" + PAD.format(6) * 400 + "</p>"), None),
    }
    rows = good + [(i, "u", "h", h, n, 200, "x", "y") for i, (h, n) in {**odd, **fine}.items()] + [(100, "u", "h", odd[100][0], None, 200, "x", "y")]
    df = spark.createDataFrame(rows, BASE)
    got = [r["page_id"] for r in residue.residue_pages(df).collect()]
    assert sorted(got) == sorted(odd)
    assert residue.residue_pages(df.limit(0)).count() == 0


def test_messages_are_known_by_their_fetches(spark):
    """No phrase list has these texts; a text that stands beside a known one follows; real pages with an error status stay."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(12)) + ", frei ab sofort."
    rows = [(i, f"g{i}", "h", site(f"<h1>Haus {i}</h1><p>{text()}</p>"), None, 404 if i % 40 == 0 else 200, "x", "y") for i in range(120)]
    told, beside = "Страница {} больше не существует.", "Ilmoitus {} on jo poistettu."
    rows += [(200 + i, f"t{i}", "h", site(f"<p>{told.format(i)}</p>"), None, 404 if i < 7 else 200, "x", "y") for i in range(9)]
    rows += [(300 + i, f"b{i}", "h", site(f"<p>{told.format(i)}</p><p>{beside.format(i)}</p>"), None, 200, "x", "y") for i in range(5)]
    rows += [(400, "s", "h", site(f"<p>{beside.format(7)}</p>"), None, 200, "x", "y"), (401, "r", "h", site("<p>Ruhig gelegen.</p>"), None, 404, "x", "y"), (402, "m", "h", site(f"<p>{told.format(8)}</p><p>{text()}</p>"), None, 404, "x", "y")]
    df = spark.createDataFrame(rows, BASE)
    got = {r["page_id"] for r in residue.residue_pages(df).collect()}
    assert got == {*range(200, 209), *range(300, 305), 400}
    assert residue.residue_pages(df, evidence=False).count() == 0


def test_real_sentences_of_other_languages_are_no_filler():
    for text in ("Talo ja piha ja meri ovat kaikki lähellä asemaa", "Ev ve bahçe ve deniz hepsi istasyona çok yakın", "Дом и сад и море рядом со станцией"):
        assert residue.label_text("p", text)[0] == residue.REAL
    assert residue.label_text("p", "Porta testum aqualin aqualin peretis vor")[0] == residue.FILLER


def test_labels_spread_over_components(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    p = residue.Prints()
    texts = [" ".join(base), " ".join([*base[:-1], "neu"]), " ".join([*base[1:-1], "neu"]), " ".join(rng.choice(words) for _ in range(120))]
    units = [(*p.of(t)[:2], 1 if i == 0 else 0, p.of(t)[2]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(u, label, sim, prints) for u, sim, label, prints in units], "unit long, label int, sim long, prints array<int>")
    got = {r["unit"] for r in residue.propagate(df).collect()}
    assert got == {u[0] for u in units[:3]}


def test_every_near_duplicate_is_linked(spark):
    """Against brute force: sets of five-word shingles with a similarity from 0.75 to 1."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    p, rows, want = residue.Prints(), [], set()
    for n, longer, reps in ((8, 1, 60), (16, 4, 60), (20, 5, 60), (20, 1, 40), (112, 28, 30), (24, 7, 30)):
        for _ in range(reps):
            base = [word() for _ in range(n + 4)]
            (u0, s0, a), (u1, s1, b) = p.of_many([" ".join(base), " ".join([*base, *(word() for _ in range(longer))])])
            rows += [(u0, 1, s0, a), (u1, 0, s1, b)]
            want |= {u0} | ({u1} if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) else set())
    df = spark.createDataFrame(rows, "unit long, label int, sim long, prints array<int>")
    assert {r["unit"] for r in residue.propagate(df).collect()} == want
    assert 450 < len(want) < len(rows)


def test_long_chains_are_followed_to_the_end(spark):
    """Each text has one shingle other than the text before."""
    p, words = residue.Prints(), [f"{chr(97 + i // 26)}{chr(97 + i % 26)}wort" for i in range(70)]
    texts = [" ".join(words[i : i + 20]) for i in range(27)]
    rows = [(u, int(i == 0), s, h) for i, (u, s, h) in enumerate(p.of_many(texts))]
    df = spark.createDataFrame(rows, "unit long, label int, sim long, prints array<int>")
    got = [r["unit"] for r in residue.propagate(df, 0.88).collect()]
    assert sorted(got) == sorted(r[0] for r in rows)


def test_long_messages_and_filler_in_one_block():
    wait = "Bitte warten Sie einen Augenblick. Wir prüfen Ihren Browser, bevor es weitergeht. Bestätigen Sie, dass Sie ein Mensch sind. Aktivieren Sie JavaScript und laden Sie die Seite neu. Es gab zu viele Anfragen aus Ihrem Netz, versuchen Sie es später noch einmal."
    fill = "Hier steht später Ihr Text. Das ist ein Blindtext für die Vorlage. Ein Musterabsatz zeigt die Länge der Zeilen. " * 4
    real = " ".join(PAD.format(i) for i in range(4)) + " Der Stellplatz ist nicht mehr verfügbar."
    assert len(wait) > 220 and len(fill) > 400 and len(real) > 400
    assert [residue.label_text("p", x)[0] for x in (wait, fill, real)] == [residue.MESSAGE, residue.FILLER, residue.REAL]


# 4 garbled text
SOUND = "Größe 72 m² – Preis 614.000 € · „schön“ Fußweg über die Straße, déjà vu à côté, mañana señor, Квартира, Διαμέρισμα, żółw, naïve Œuvre 5 °C ½ ©"


@pytest.mark.parametrize("pair", garbled.PAIRS, ids=lambda p: p[0])
def test_each_pair_is_found_and_undone(pair):
    text = "<p>Größe und Fläche: 72 m² für 614.000 € in Mühlbüttel. Übergabe im Frühjahr, schöner Blick, Straße ruhig.</p>" * 3
    bad = garbled.garble(text, pair[1], pair[2])
    names, lost, back = garbled.examine(bad)
    assert names and lost == 0 and back == text


def test_sound_text_stays():
    assert garbled.examine(SOUND) == ([], 0, None)
    for t in ("", None, "plain", "Erscheint statt „ä“ ein „Ã¤“, so ist der Zeichensatz falsch.", "Si « Ã© » apparaît", "Hаus Ｈａｕｓ ﬁn"):
        assert garbled.examine(t)[0] == []
    assert garbled.examine("die K�che")[:2] == (["lost"], 1)
    assert garbled.examine("in die KÃ¼che und")[2] == "in die Küche und"


def test_garbled_pages(spark):
    df = spark.createDataFrame([(1, "u", "h", "KÃ¼che " * 20_000, None, 200, "x", "y"), (2, "u", "h", None, None, 200, "x", "y"), (3, "u", "h", "", None, 200, "x", "y"), (4, "u", "h", "Küche", None, 200, "x", "y"), (1, "u", "h", "KÃ¼che", None, 200, "x", "y")], BASE)
    got = garbled.examine_pages(df).collect()
    assert [r["page_id"] for r in got] == [1, 1] and all("Ã" not in r["restored"] for r in got)
    assert garbled.examine_pages(df.limit(0)).count() == 0


# 5 boilerplate
WORDS = ["".join(random.Random(n).choices("abcdefghijklmnop", k=7)) for n in range(300)]


def test_main_body(spark):
    def html(i):
        return f'<body><div class="a"><a href="/">Makler</a></div><ul class="b"><li><a href="/1">Start</a><li><a href="/2">Kontakt</a></ul><div class="c"><h1>Haus {i}</h1><p>{PAD.format(i)}</p><div class="p">Newsletter abonnieren</div></div><div class="s"><h3>Beliebt</h3><ul><li><a href="/o/{i}">Objekt {i}</a></ul></div><div class="z"><p>Impressum</p></div></body>'

    from pageloom.functions.outline import Outliner

    pages = [(i, "u", "h", html(i), None, 200, "x", "y") for i in range(30)] + [(50, "u", "h", None, None, 200, "x", "y"), (51, "u", "g", "<p>allein</p>", None, 200, "x", "y"), (3, "u", "h", html(3), None, 200, "x", "y")]
    rows = [(p[0], i, "h", k, t, "main", "v") for p in pages[:-1] for i, (_, k, t, _) in enumerate(Outliner().blocks(p[3] or ""))] + [(60, 0, "h", "p", "ohne Seite", "nav", "v"), (60, 1, "h", "p", "ohne Seite", "main", "v")]
    blocks = spark.createDataFrame(rows, "page_id long, block_id int, host string, kind string, text string, region string, node string")
    got = {tuple(r) for r in styletree.noise_blocks(spark.createDataFrame(pages, BASE), blocks).collect()}
    text = {(r[0], r[1]): r[4] for r in rows}
    assert {text[g] for g in got if g[0] == 3} == {"Makler", "Start", "Kontakt", "Newsletter abonnieren", "Beliebt", "Objekt 3", "Impressum"}
    assert {g for g in got if g[0] in (51, 60)} == {(60, 0)}
    assert styletree.noise_blocks(spark.createDataFrame(pages, BASE).limit(0), blocks.limit(0)).count() == 0
    body = styletree.body_blocks(spark.createDataFrame(pages, BASE), blocks).collect()
    assert {(r["page_id"], r["block_id"]) for r in body} == set(text) - got
    assert {(r["page_id"], r["judged_by"]) for r in body} == {*((i, "tree") for i in (*range(30), 51)), (60, "region")}


def test_pages_that_forget_to_close_a_tag(spark):
    """The path of a node is the one that most pages have, and a branch goes as a whole."""
    def html(i, close="</div>"):
        return f'<body><div class="menu"><a href="/">Makler</a>{close}<div class="main"><h1>Haus {i}</h1><div class="text"><p>{" ".join(random.Random(i).choices(WORDS, k=30))}</p></div><div class="box"><p>Rufen Sie uns an</p><div class="in"><p>Wir helfen gern weiter</p></div></div></div><div class="end"><p>Impressum</p></div></body>'

    pages = spark.createDataFrame([(i, "u", "h", html(i, "" if i == 7 else "</div>"), None, 200, "x", "y") for i in range(40)], BASE)
    verdicts = {r["node"]: (r["chain"], r["why"]) for r in styletree.node_verdicts(styletree.page_nodes(pages)).collect()}
    path = lambda *n: "\x1f".join(("body", *n))
    assert verdicts["div.text"] == (path("div.main", "div.text"), None)
    assert {n: w for n, (_, w) in verdicts.items() if w} == {"div.menu": "outside", "div.box": "repeated", "div.in": "repeated", "div.end": "outside"}


# 6 tokens
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=300), st.integers(1, 40))
def test_pieces_are_safe(text, size):
    enc = tokens.encoder(tokens.rank_path())
    parts = tokens.pieces(text, size)
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert tokens.decode(enc, enc.encode_ordinary(text)) == text.encode()


def test_ids_are_those_of_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [None, "", " ", "Grüße  aus\n\nMühlbach!", "<|endoftext|> don't 12abc", "a" * 40_000, "ab 12 " * 9_000, "\x00​", "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = tokens.encode_documents(df)
    got = {r["doc_id"]: r["ids"] for r in enc.collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
    assert all(r["same"] for r in tokens.verify_round_trip(df, enc).collect())
    assert tokens.encode_documents(df.limit(0)).count() == 0


# 7 mixing
@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500)), min_size=3, max_size=60), st.integers(0, 99))
def test_flight_keeps_both_totals(units, seed):
    pi, size = np.array([u[0] for u in units]), np.array([float(u[1]) for u in units])
    out = mixing.flight(pi, size, np.random.default_rng(seed))
    assert abs(out.sum() - pi.sum()) < 1e-4 and abs(out @ size - pi @ size) < 1e-2
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("haus garten see blick wald tor".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(5, 60))), "abc"[i % 3] if i % 3 else "a", 1) for i in range(900)]
    docs += [(2000, docs[5][1], "b", 1), (2001, None, "a", 1), (2002, "", "a", 1), (2003, "x y", None, 1), (2004, "x y", "zzz", 1), (2005, "lang " * 20_000, "b", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens long")
    t = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.2, 2), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, total_tokens=30_000, block=100)
    got = m.collect()
    cap = {"a": 1, "b": 3, "c": 2}
    assert all(0 < r["copies"] <= cap[r["source"]] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    assert not {r["doc_id"] for r in got} & {2000, 2001, 2002, 2003, 2004}
    s = {r["source"]: r["actual_share"] for r in mixing.shares_of(m, t).collect()}
    for name, share in (("a", 0.2), ("b", 0.5), ("c", 0.2)):
        assert abs(s[name] - share / 0.9) < 0.03
    assert s["none"] == 0
    assert mixing.mix(d.limit(0), t).count() == 0


# 8 reading level
EASY, HARD = "Das Haus ist alt . Der Hof ist klein . Wir mögen den Garten . Komm vorbei . Die Tür ist rot .", "Die akzessorische Mithaftung des Grundstückserwerbers erstreckt sich, sofern keine anderweitige Fälligkeitsregelung getroffen wurde, ungeachtet schuldrechtlicher Ausgestaltung auch auf rückständige Hausgeldforderungen; gleichwohl bleibt die Anspruchsverfolgung vorbehalten."


def test_levels(spark):
    rng = random.Random(6)
    easy, hard = EASY.split(" . "), HARD.split(", ")
    docs, labels = [], []
    for i in range(240):
        hardish = i % 2
        parts = hard if hardish else easy
        docs.append((i, (", " if hardish else ". ").join(rng.sample(parts, len(parts) - 1)) + ".", 9))
        if i < 200:
            labels += [(i, (5 if hardish else 1) + (0 if rng.random() < 0.9 else (-1 if hardish else 1)), "g", i)]
    docs += [(900, None, 9), (901, "", 9), (902, "12 34 5", 9), (903, "ha" * 5_000, 9), (904, HARD * 300, 9)]
    labels += [(3, None, "g", 0), (4, 1, "g", 4), (4, 1, "g", 4)]
    d, k = spark.createDataFrame(docs, "doc_id long, text string, reading_level int"), spark.createDataFrame(labels, "doc_id long, reading_level int, grader string, n int")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(d, k).collect()}
    assert all((got[i] >= 4) == bool(i % 2) for i in range(200, 240)) and got[904] >= 4
    assert [got[i] for i in (900, 901, 902, 903)] == [None] * 4
    assert {r["reading_level"] for r in reading.reading_levels(d, k.limit(0)).collect()} == {3, None}
    assert reading.reading_levels(d.limit(0), k).count() == 0


def test_isotonic():
    x, y = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 5]))
    assert list(y) == [1, 2.5, 5] and list(x) == [1, 2.5, 4]

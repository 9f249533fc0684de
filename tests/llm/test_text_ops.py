"""PII, toxicity, HTML, licences, chat, decontamination and mixing on small tables."""

import random
import re
from fractions import Fraction
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from embertide.llm import chat_format, decontaminate, html_extract, license_scan, mixing, pii, toxicity

# --- PII ----------------------------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    """The contract's patterns, as they stand."""
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_base_spans_are_the_patterns():
    r = random.Random(0)
    pieces = ["a", "b@c", "@", ".", "-", "x.y", "12", "255", "256", "1.2.3.4", " ", "\n", "+1", "(456) 555-2186", "4111 1111 1111 1111", "é", "%", "00", "a@b.c@d.e", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        t = "".join(r.choices(pieces, k=r.randint(0, 9)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_field_finds_what_patterns_miss_and_keeps_base():
    model = pii.trained()
    texts = ["est nd password=7602ad27cf5550de1c st and", "call 555-867-5309 now", "mail x.42@mail8.example.com thbl +1 (988) 555-2485 orthen", "just plain words here", ""]
    found = pii.find_pii(texts, model)
    assert [k for k, _, _ in found[0][1]] == ["secret"] and [k for k, _, _ in found[1][1]] == ["phone"]
    assert [s for s in found[2][1] if s in found[2][0]] == found[2][0] and found[3] == ([], []) == found[4]


def label_spans(labels):
    from itertools import groupby

    out, at = set(), 0
    for label, run in groupby(labels):
        n = len(list(run))
        out |= {(label, at, at + n)} if label != "O" else set()
        at += n
    return out


def test_field_spans_on_a_held_out_table():
    model = pii.trained()
    held = pii.labelled_table(400, seed=99)
    right = found = planted = 0
    for row in held:
        words = [w for w, _ in row]
        path = [pii.LABELS[p] for p in model.decode([model.emissions(words)])[0]]
        got, want = label_spans(path), label_spans([y for _, y in row])
        right, found, planted = right + len(got & want), found + len(got), planted + len(want)
    assert right / found > 0.97 and right / planted > 0.97


def test_secrets_stand_in_chains_and_plain_hex_does_not():
    model, r = pii.trained(), random.Random(3)
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(60)]
    forms = ["{w} token = \"{h}\" {w}", "{w} | token = \"{h}\" | {w}", "token = \"{h}\" {w} {w}", "{w} password={h} {w}", "{w} secret: '{h}' {w}", "{w} TOKEN = \"{h}\"!! {w}"]
    plain = ["{w} commit {h} {w}", "{w} the token economy {w}", "sha = \"{h}\" {w}", "{w} {h} {w}", "{w} the key = value pair {w}", "{w} token and {w}"]
    fill = lambda t, h: t.format(w=r.choice(["est", "nd", "verlich", "Éré."]), h=h)
    texts = [fill(r.choice(forms), h) for h in hexes]
    found = pii.find_pii(texts, model)
    assert sum(any(k == "secret" and h in t[a:b] for k, a, b in spans) for t, h, (_, spans) in zip(texts, hexes, found)) > 0.95 * len(texts)
    assert sum(bool(spans) for _, spans in pii.find_pii([fill(r.choice(plain), h) for h in hexes], model)) <= 1


def test_runs_between_sure_words_give_the_whole_path():
    import numpy as np

    model, r = pii.trained(), random.Random(4)
    for _ in range(60):
        words = [w for row in r.sample(pii.labelled_table(60, seed=r.randrange(99)), 4) for w, _ in row]
        e = model.emissions(words)
        e += np.random.default_rng(len(words)).normal(0, r.choice([0, 1, 3]), e.shape)
        loose, whole = model.possible(e), model.decode([e])[0]
        assert not whole[~loose].any()
        cut = np.zeros_like(whole)
        edge = np.flatnonzero(np.diff(loose.astype(int), prepend=0, append=0))
        for (a, b), path in zip(zip(edge[::2], edge[1::2]), model.decode([e[a:b] for a, b in zip(edge[::2], edge[1::2])])):
            cut[a:b] = path
        score = lambda p: model.step[0, p[0]] + e[np.arange(len(p)), p].sum() + model.step[p[:-1], p[1:]].sum() + model.step[p[-1], 0]
        assert score(cut) == pytest.approx(score(whole))


def test_training_counts_starts_and_ends():
    import numpy as np

    # a label that always starts and ends its text pays for the steps from and to O, so all paths sum to one
    table = [[("a@b.c", "email"), ("x", "O")], [("x", "O"), ("1.2.3.4", "ip")]] * 4
    model = pii.ShapeCRF(table, steps=60)
    from itertools import product

    e, k = model.emissions(["a@b.c", "x"]), len(pii.LABELS)
    score = {p: model.step[0, p[0]] + e[0, p[0]] + model.step[p[0], p[1]] + e[1, p[1]] + model.step[p[1], 0] for p in product(range(k), repeat=2)}
    best = max(score, key=score.get)
    assert [pii.LABELS[y] for y in best] == ["email", "O"] and np.isfinite(list(score.values())).all()


def test_viterbi_is_brute_force():
    from itertools import product

    import numpy as np

    model, r = pii.trained(), np.random.default_rng(1)
    runs = [r.normal(0, 3, (n, len(pii.LABELS))) for n in (1, 2, 3, 4, 4)]
    for e, path in zip(runs, model.decode(runs)):
        score = lambda p, e=e: model.step[0, p[0]] + sum(e[i, y] for i, y in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:])) + model.step[p[-1], 0]
        assert score(path) == pytest.approx(max(map(score, product(range(len(pii.LABELS)), repeat=len(e)))))


def test_pii_rows(spark):
    long = "wort " * 200_000 + "a@b.c " + "1" * 100_000
    (row,) = pii.scan_pii(spark.createDataFrame([(4, long)], "doc_id long, text string")).collect()
    assert (row.n_email, row.base) == (1, f"email:{5 * 200_000}:{5 * 200_000 + 5}")
    df = spark.createDataFrame([(1, None, 5), (None, "1.2.3.4", 6), (1, "é a@b.c", 7)], "doc_id long, text string, spans long")
    got = [tuple(r) for r in pii.scan_pii(df).collect()]
    assert (1, 0, 0, 0, 0, "", "") in got and (None, 0, 1, 0, 0, "ip:0:7", "ip:0:7") in got and (1, 1, 0, 0, 0, "email:2:7", "email:2:7") in got
    assert pii.scan_pii(df.limit(0)).collect() == []


# --- toxicity -------------------------------------------------------------------
def test_toxicity_learns_stems_and_handles_edges(spark):
    r = random.Random(5)
    words = ["".join(r.choices(["ba", "no", "ti", "re", "lu", "ka"], k=r.randint(1, 4))) for _ in range(300)]
    bad = ["zorg" + s for s in ("", "ing", "ed", "lich", "ous", "al", "es")]
    rows, labels = [], []
    for i in range(400):
        y = i % 4 == 0
        text = r.choices(words, k=r.randint(5, 60)) + (r.choices(bad, k=3) if y else [])
        r.shuffle(text)
        rows.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(y)))
    rows += [(1000, None, "x"), (None, "ba no", "x"), (1001, "", "x"), (1002, "zorgism zorgable " + "ba " * 10, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert got[1000] == got[1001] < 0.5 and got[1002] > 0.5
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 1002 not in {x.doc_id for x in kept.collect()}
    assert toxicity.fit(docs, lab.where("toxic = 0")).score(["zorg"])[0] < 0.5


def brute_backoff(words):
    """Kneser-Ney over continuation counts, written out: (gram up to ORDER - 1 characters) -> probability of its last character."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    grams, levels = {g for w in words for g in toxicity.ngrams(toxicity.clean(w))}, {}
    for k in range(order - 1, 0, -1):
        count = {}
        for g in grams:
            cut = g[1:] if len(g) > k else g
            count[cut] = count.get(cut, 0) + 1
        levels[k], grams = count, set(count)
    p = None
    for k in range(1, order):
        total, kinds = {}, {}
        for g, c in levels[k].items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
        lower = lambda g, k=k, p=p: 1 / len(levels[k]) if p is None else p[g[1:] if len(g) > k - 1 else g]
        p = {g: (max(c - d, 0) + d * kinds[g[:-1]] * lower(g)) / total[g[:-1]] for g, c in levels[k].items()}
    return p


def test_shared_backoff_is_kneser_ney_written_out(spark):
    r = random.Random(9)
    texts = [" ".join("".join(r.choices("abcé", k=r.randint(1, 9))) for _ in range(30)) for _ in range(12)] + ["", None, "a.b! (c)"]
    got = {x.gram: x.p for x in toxicity._shared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute_backoff({w for t in texts if t for w in t.lower().split()})
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)
    by = {}
    for g, x in got.items():
        by[g[:-1]] = by.get(g[:-1], 0) + x
    assert all(0 < x <= 1 + 1e-9 for x in by.values())


def test_toxicity_of_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, f"ba no {'zorg' if i % 2 else 'ti'} re " * 3) for i in range(40)] * 2, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 80 and len({(x.doc_id, x.score) for x in got}) == 40
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == [] and toxicity.drop_toxic(docs.limit(0), model).collect() == []
    plain = toxicity.fit(docs, lab.limit(0))
    assert toxicity.drop_toxic(docs, plain).count() == 80 and toxicity.fit(docs.limit(0), lab).score(["x", ""])[0] < 0.5
    long = toxicity.score_toxicity(spark.createDataFrame([(1, "ba no ti " * 300_000)], "doc_id long, text string"), model).collect()
    assert 0 <= long[0].score <= 1


# --- HTML -----------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>%s</h1><p><b>%s<br><p>one &amp; two &lt;
   three</p><p class="advert">no<p>end</p><aside>side</aside><form>f<input></form><section class="comments"><p>c</p></section></article><div id="sidebar">s</div><footer>&copy; f</footer></body></html>"""


def test_html_text_and_edges(spark):
    assert html_extract.main_text(PAGE % ("A", "B")) == "A\nB\none & two < three\nend"
    rows = [(i, f"http://h.example/{i}", PAGE % (f"title {i}", f"text {i}")) for i in range(12)] + [(90, None, None), (91, "x", ""), (91, "x", "<p>a<p>b &eacute;")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()]
    for i in range(12):
        text = f"title {i}\ntext {i}\none & two < three\nend"
        assert any(p == i and t.startswith(f"title {i}\ntext {i}") and n == len(t) for p, t, n in got), text
    assert (90, "", 0) in got and (91, "", 0) in got and (91, "a\nb é", 5) in got
    assert html_extract.extract_pages(df.limit(0)).collect() == []


def story(r, k=30):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(k))


def neutral(i, r, layout="x"):
    """A page with class names that tell nothing: a menu, an offer, a notice, the story, some varying small print."""
    menu = "".join(f"<div class=q7><a href='/{k}'>{k}</a></div>" for k in ("Home", "World", "Shop"))
    top = "<div class=k3><p>Our offer of the week: two for one</p></div>"
    own = f"<div class=z1{layout}><h1>Title {i}</h1><div class=z2><p>{story(r)}<p>{story(r)} &amp; {i}</div></div>"
    small = f"<div class=k9><p>seen {i} times</p><p>We value your privacy</p></div>"
    parts = [f"<div class=k1>{menu}</div>", top, own, small] if layout == "x" else [own, small, f"<div class=k1>{menu}</div>", top]
    return "<html><head><title>t</title></head><body>" + "".join(parts) + "</body></html>"


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_tells_story_from_neutral_furniture(spark):
    r = random.Random(2)
    rows = [(i, f"https://h.example/{i}", neutral(i, r, "xy"[i % 2])) for i in range(20)] + [(100 + i, "https://three.example/", neutral(i, r)) for i in range(3)]
    got = extracted(spark, rows)
    for i, _, page in rows:
        want = re.search(r"<h1>(.*?)</h1><div class=z2><p>(.*?)<p>(.*?)</div>", page).groups()
        assert got[i] == "\n".join(want).replace("&amp;", "&"), i
    few = extracted(spark, rows[:2])  # no template on a host of two pages: names decide, and tell nothing
    assert "two for one" in few[0]


def test_template_text_is_dropped_where_a_host_repeats_it(spark):
    page = "<html><body><article><p>{0}</p><p>more {1}</p><div><p>Subscribe to our letter</p></div></article></body></html>"
    r = random.Random(1)
    rows = [(i, f"https://h.example/{i}", page.format(story(r), i)) for i in range(20)] + [(50, "https://few.example/", page.format("one", 1))]
    got = extracted(spark, rows)
    assert all("Subscribe" not in got[i] and got[i].endswith(f"more {i}") for i in range(20)) and got[50].endswith("letter")


def test_copies_and_shared_passages_are_no_template(spark):
    r = random.Random(3)
    page = "<html><body><article><h1>{0}</h1><p>{1}</p><p>{2}</p></article></body></html>"
    same = story(r, 60)
    rows = [(i, "https://copies.example/", page.format("T", same, story(r, 60) if i == 9 else same)) for i in range(3)]
    rows += [(10 + i, "https://near.example/", page.format("T", same, f"{same[:40].strip()} {i}")) for i in range(4)]
    rows += [(20 + i, "https://passage.example/", page.format(i, same if i < 4 else story(r), story(r))) for i in range(12)]
    got = extracted(spark, rows)
    assert all(got[i] == f"T\n{same}\n{same}" for i in range(3))
    assert all(got[10 + i] == f"T\n{same}\n{same[:40].strip()} {i}" for i in range(4)) and all(same in got[20 + i] for i in range(4))


def test_names_give_way_to_the_template(spark):
    r = random.Random(4)
    page = "<html><body><div class=ad>{2}</div><div class='search-results'><p>{0}</p></div><article-x></article-x><div class=comments><p>c {1}</p></div></body></html>"
    rows = [(i, "https://s.example/", page.format(story(r, 50), i, "Buy")) for i in range(5)]
    got = extracted(spark, rows)
    assert all(got[i] == re.search("<p>(.*?)</p>", rows[i][2])[1] for i in range(5))
    head = "<article><div class='post-header'><h1>Title</h1></div><p>one</p><div class='comments'><p>c</p></div></article>"
    assert html_extract.main_text(head) == "Title\none"


def test_classes_are_brute_force(spark):
    r = random.Random(5)
    pages = [neutral(i, r, "xyx"[i % 3]) for i in range(9)]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = {(c.key, c.layout, c["class"]) for c in html_extract.deduce_classes(df).collect()}
    counts = [__import__("collections").Counter(t for t in html_extract.Page(p).tokens()) for p in pages]
    tokens = set().union(*counts)
    on = {t: frozenset(i for i, c in enumerate(counts) if t in c) for t in tokens}
    tags = __import__("collections").Counter(on[t] for t in tokens if t[2])
    kept = {t for t in tokens if len(on[t]) >= html_extract.MIN_PAGES and tags[on[t]] >= html_extract.LAYOUT_TAGS}
    vector = {t: (tuple(c[t] for c in counts), t[1]) for t in kept}
    assert {k for k, _, _ in got} == {t[0] for t in kept}
    for group, by in ((lambda k: k[1], lambda t: on[t]), (lambda k: k[2], lambda t: vector[t])):
        mine, theirs = {}, {}
        for k in got:
            mine.setdefault(group(k), set()).add(k[0])
        for t in kept:
            theirs.setdefault(by(t), set()).add(t[0])
        assert set(map(frozenset, mine.values())) == set(map(frozenset, theirs.values()))


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<p>end" + "</div>" * 20_000
    assert html_extract.main_text(deep) == "end"
    assert html_extract.main_text("<b>" * 5_000 + "<p>x<p>y" + "</i>" * 5_000) == "x\ny"
    long = "<article>" + "<p>wort &eacute;" * 50_000
    assert html_extract.main_text(long) == "\n".join(["wort é"] * 50_000)


# --- licences -------------------------------------------------------------------
def test_licenses(spark):
    t = license_scan.TEMPLATES
    texts = [
        "foo\nLicensed under CC BY-NC 4.0.\nbar", "Released under the MIT License.", "Copyright 2020 X\n" + t["MIT"][3].replace(". ", ".\n"),
        t["BSD-3-Clause"][2], t["BSD-2-Clause"][2], "This work is licensed under the GNU General Public License, version 3.", "no permission", None, "",
        "Licensed under the Apache License, Version 2.0. é", "a license to kill is not granted",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hits", F.lit(0))
    got = {r.doc_id: [h.license for h in r.hits] for r in license_scan.scan_licenses(df).collect()}
    assert got == {0: ["CC-BY-NC-4.0"], 1: ["MIT"], 2: ["MIT"], 3: ["BSD-3-Clause"], 4: ["BSD-2-Clause"], 5: ["GPL-3.0"], 6: [], 7: [], 8: [], 9: ["Apache-2.0"], 10: []}


def test_every_license_of_a_long_notice_is_found():
    t = license_scan.TEMPLATES
    for pick in (0, -1):
        notice = "\n".join(f"component {i}: {own[pick]}" for i, own in enumerate(t.values()))
        # the text of BSD-2-Clause is a part of that of BSD-3-Clause
        assert {f[0] for f in license_scan.scan_block(notice)} >= set(t) - ({"BSD-2-Clause"} if pick else set())
    for name, own in t.items():
        for text in own:
            around = "this copyright line tells of the many authors who wrote parts of it over years and years"
            assert name in {f[0] for f in license_scan.scan_block(f"{around}\n{text}\n{around[::-1]} license")}, text


def test_plain_reservation_is_proprietary():
    found = lambda text: {f[0] for f in license_scan.scan_block(text)}
    assert found("All rights reserved.") == found("Copyright 2020 X. ALL RIGHTS RESERVED") == {"Proprietary"}
    assert found("a: All rights reserved.\nb: Released under the MIT License.") == {"Proprietary", "MIT"}
    headed = "Copyright X. All rights reserved.\n\n" + license_scan.TEMPLATES["BSD-3-Clause"][2]
    assert found(headed) == {"BSD-3-Clause"} and found(f"{headed}\nY: All rights reserved.") == {"BSD-3-Clause", "Proprietary"}
    assert found("not all the rights that were reserved") == set()


def brute_licenses(block):
    """The rule of scan_block without ranking, prefilter or memory: every wording against every stretch of the block."""
    from difflib import SequenceMatcher

    have, best = license_scan.words_of(block), {}
    reserved = license_scan.words_of("All rights reserved.")
    for name, texts in license_scan.TEMPLATES.items():
        for text in texts:
            own = license_scan.words_of(text)
            words = license_scan._without_headings(have) if own == reserved else have
            for start in range(0, max(1, len(words) - len(own) + 1)):
                part = words[start : start + len(own) + max(1, len(own) // 5)]
                kept = [m for m in SequenceMatcher(None, part, own, autojunk=False).get_matching_blocks() if m.size]
                if not kept:
                    continue
                same, span = sum(m.size for m in kept), part[kept[0].a : kept[-1].a + kept[-1].size]
                if len(own) - same <= 0.1 * len(own) and len(span) - same <= max(1, 0.1 * len(own)) and license_scan._telling(own) == license_scan._telling(span):
                    if len(own) - same < len(own) and same > len(best.get(name, ())):
                        best[name] = own
    return {n for n in best if not any(license_scan._within(best[n], best[m]) for m in best if m != n)}


def test_licenses_are_brute_force():
    r = random.Random(11)
    every = [text for texts in license_scan.TEMPLATES.values() for text in texts]
    filler = "river stone walks quietly under license of the green copyright".split()
    for _ in range(60):
        parts = []
        for text in r.sample(every, r.randint(0, 3)):
            words = text.split()
            for _ in range(r.choice([0, 0, 1, len(words) // 12, len(words) // 6])):
                words[r.randrange(len(words))] = r.choice(filler)
            parts.append(" ".join(words))
            parts.append(" ".join(r.choices(filler, k=r.randint(0, 60))))
        block = "\n".join(parts) or "license"
        assert {f[0] for f in license_scan.scan_block(block)} == brute_licenses(block), block


def test_license_edges(spark):
    t = license_scan.TEMPLATES
    long = "license " + "word and other words " * 100_000 + t["MIT"][3] + " more words " * 100_000
    rows = [(1, long), (None, "SPDX-License-Identifier: MIT"), (2, "SPDX-License-Identifier: MIT"), (2, "SPDX-License-Identifier: MIT")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, [h.license for h in r.hits]) for r in license_scan.scan_licenses(df).collect())
    assert got == [(-1, ["MIT"]), (1, ["MIT"]), (2, ["MIT"]), (2, ["MIT"])]
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


# --- chat -----------------------------------------------------------------------
def test_chat_round_trip(spark):
    r = random.Random(6)
    pieces = ["\\", "</turn>", "### ", "Assistant: ", ": ", "\n", "a", "é", "</", "turn>", "#", "\\\\", " "]
    rows = [(c, t, r.choice(["user", "assistant", "a: b", "x\\", None, ""]), r.choice([None, "".join(r.choices(pieces, k=r.randint(0, 8)))])) for c in range(120) for t in range(r.randint(1, 5))]
    rows += [(None, 0, "user", "lost"), (None, 1, "user", "lost"), (500, None, "assistant", "x"), (500, None, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = chat_format.format_conversations(df.withColumn("src", F.lit("clash")).withColumn("rendered", F.lit(1)))
    assert convs.where("not round_trip").count() == 0
    got = {x.conv_id: x for x in chat_format.digests(convs).collect()}
    assert convs.where("conv_id is null").count() == 2  # each a conversation of its own
    for c in {x[0] for x in rows} - {None}:
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        said = "".join(x[3] for x in own if x[2] == "assistant")
        whole = "".join(f"{x[2]}\n{x[3]}\n" for x in own)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), sha256(said.encode()).hexdigest())


def test_chat_refuses_what_does_not_read_back(spark):
    df = spark.createDataFrame([(1, 0, "user", "x " * 300_000), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    convs = chat_format.format_conversations(df)
    (row,) = chat_format.digests(convs).collect()
    assert (row.n_turns, row.loss_chars) == (2, 1)
    with pytest.raises(Exception, match="doesn't read back: 1"):
        chat_format.digests(convs.withColumn("round_trip", F.lit(False))).collect()
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).collect() == []


# --- decontamination --------------------------------------------------------------
def test_decontamination_catches_copies_and_new_parameters(spark):
    item = "A farmer sells 12 apples to Anna and then 7 more apples to Boris so how many kg of the 12 apples does the farmer have left now"
    other = item.replace("12", "31").replace("7", "9").replace("Anna", "Clara").replace("Boris", "Dmitri")
    broken = item.replace("12", "31", 1).replace("12 apples does", "88 apples does")
    r = random.Random(7)
    noise = lambda: " ".join(r.choices(["the", "of", "river", "stone", "walks", "quietly", "green"], k=40))
    texts = [noise(), noise() + " " + item + " " + noise(), noise() + "\n" + other, noise() + " " + broken, None, "", item.upper(), "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.lit(1))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (None, noise())], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    assert {(1, 1), (2, 1), (7, 3)} <= got and (0, 1) not in got and (3, 1) not in got
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {0, 4, 5} <= {x.doc_id for x in kept.collect()}
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == []


def test_decontamination_catches_items_of_numbers(spark):
    items = ["What is 347 + 589 - 122 * 4 + 16 / 8 - 77 + 5?", "Compute 12 * 35 + 48 / 6 - 9 * 3 + 41 - 8", "Add 3 and 4 to 5", "Compute 13 * 36",
             "Every farmer in this village sells some apples on market days: 3 4 5 6 7 8 9 10 11 12 13 14 15 16"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"Some words stand before it. {t} And some more words stand after it." for t in items]
    texts += ["What is 348 + 589 - 122 * 4 + 17 / 8 - 78 + 5?", "Add 3 and 9 to 5", "what is 1 2 3 4 5 6 7 8 9", items[4][:63] + " 103 104 105 106 107 108 109"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id): (x.windows, x.n_item_windows) for x in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(i, i) for i in range(5)} | {(8, 4)}
    assert all(got[i, i][0] == got[i, i][1] for i in range(5)) and got[1, 1][0] > 0 and got[8, 4][0] < got[8, 4][1]


def brute_leaks(docs, items):
    """The rule of contaminated, spelled out over all windows of all rows."""
    words = lambda t: [(w if w[0] >= "\x04" else w[0], w) for w in canon(t)]
    mark = decontaminate
    held, of = {}, {}
    for item, text in items:
        if item is None or not canon(text or ""):
            continue
        iw = words(text)
        own = min(len(iw), mark.WINDOW)
        for p in range(len(iw) - own + 1):
            exact = sum(w[0] >= "\x04" for _, w in iw[p : p + own]) < min(mark.PLAIN_WORDS, own)
            of.setdefault(item, {})[text, p] = exact
        for doc, body in set(docs):
            if doc is None:
                continue
            dw = words(body or "")
            for diagonal in range(-len(iw), len(dw)):
                for kind in (False, True):
                    at = [p for p in range(len(iw) - own + 1) if of[item][text, p] == kind and 0 <= p + diagonal <= len(dw) - own
                          and all(iw[p + j][kind] == dw[p + diagonal + j][kind] for j in range(own))]
                    spots = {p + j for p in at for j in range(own) if iw[p + j][0] < "\x04"}
                    pairs = {(iw[i][1], dw[i + diagonal][1]) for i in spots}
                    if at and len(pairs) == len({b for b, _ in pairs}):
                        for p in at:
                            held.setdefault((doc, item), {}).setdefault((text, p), set()).add(kind)
    out = {}
    for (doc, item), found in held.items():
        n, fresh = len(of[item]), sum(not e for e in of[item].values())
        new = sum(False in k for k in found.values())
        if len(found) >= mark.SHARE * n or len(found) >= mark.MANY or 0 < new >= mark.SHARE * fresh:
            out[doc, item] = (len(found), n)
    return out


_CANON = {}


def canon(text):
    return _CANON[text]


def leaks_of(spark, docs, items):
    texts = [(t,) for t in {t or "" for _, t in docs + items}]
    rows = spark.createDataFrame(texts, "text string").select("text", decontaminate.canonical_words(F.col("text")).alias("w")).collect()
    _CANON.update({r.text: r.w for r in rows})
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(x.doc_id, x.item_id): (x.windows, x.n_item_windows) for x in decontaminate.contaminated(d, b).collect()}


def test_decontamination_is_brute_force(spark):
    r = random.Random(12)
    words = "the farmer sells apples and then Anna buys 7 km of red thread for 12 dollars or 3 kg".split()
    sentence = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, sentence(r.choice([2, 5, 9, 14, 20]))) for i in range(12)] + [(12, None), (None, "x y"), (3, sentence(11))]
    docs = []
    for i in range(30):
        _, text = r.choice(items[:12])
        body = [w if r.random() > 0.08 else r.choice(["9", "Boris", "stone", w]) for w in text.split()]
        docs.append((i, sentence(r.randint(0, 12)) + " " + " ".join(body) + " " + sentence(r.randint(0, 12))))
    docs += [(3, docs[7][1]), (4, "short"), (4, docs[4][1]), (5, docs[5][1]), (None, items[1][1]), (77, None), (78, "")]
    got = leaks_of(spark, docs, items)
    assert got == brute_leaks(docs, [(i, t) for i, t in items])
    assert got


@pytest.mark.parametrize("turn", [1, -1])
def test_decontamination_of_rows_that_repeat_a_doc_id(spark, turn):
    item = "A farmer sells 12 apples to Anna and then 7 more apples to Boris so how many are left"
    docs = [(1, "few words here " * 30 + item), (1, item), (1, "none of it"), (2, "none of it")][::turn]
    assert set(leaks_of(spark, docs, [(5, item)])) == {(1, 5)}


def test_decontamination_with_a_shared_window_and_a_hot_document(spark):
    shared = "please answer the following question about the long story "
    items = [(i, shared + f"who met word{i} near lake{i} with friend{i} of town{i} when moon{i} rose over hill{i}") for i in range(1000)]
    hot = "start " + " and so on ".join(t for _, t in items[:300]) + " filler" * 5000
    docs = [(1, hot), (2, shared), (3, items[400][1])] + [(10 + i, shared + "nothing else of it") for i in range(20)]
    got = leaks_of(spark, docs, items)
    assert set(got) == {(1, i) for i in range(300)} | {(3, 400)}


# --- mixing -----------------------------------------------------------------------
def test_pfair_keeps_within_one_block():
    parts = {"a": 37, "b": 3, "c": 60, "d": 11}
    slots, total = mixing.pfair_period(parts), sum(parts.values())
    assert sorted(x for s in slots.values() for x in s) == list(range(total))
    for s, p in parts.items():
        for t in range(total + 1):
            assert abs(sum(x < t for x in slots[s]) - Fraction(p * t, total)) < 1


def test_mix_is_whole_and_fair(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, s) for i, s in enumerate(["hot"] * 700 + ["b"] * 230 + ["c"] * 61 + [None] * 9)] + [(3, "hot"), (None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("bucket", F.lit("clash"))
    weights = {"hot": 0.5, "b": 0.3, "c": 0.15, "": 0.05}
    got = mixing.mix(docs, weights, block_rows=4).collect()
    assert sorted((x.doc_id or -1, x.source or "") for x in got) == sorted((a or -1, b or "") for a, b in rows)
    assert len({(x.slot, x.pos) for x in got}) == len(got)
    blocks = {x.slot: x.source or "" for x in got}
    assert sorted(blocks) == list(range(len(blocks)))
    ended = min(max(t for t, s in blocks.items() if s == n) for n in weights) + 1
    for t in range(ended + 1):
        for n, w in weights.items():
            assert abs(sum(blocks[i] == n for i in range(t)) - w * t) < 1.01
    assert mixing.mix(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="without a weight"):
        mixing.mix(docs, {"hot": 1.0})


def brute_mix(rows, parts, block_rows):
    """Slot by slot: of the sources whose next block is released, the one of the earliest deadline, then the least name."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    done, order = dict.fromkeys(rows, 0), []
    while left:
        total, k = sum(parts[s] for s in left), dict.fromkeys(left, 0)
        ended, now = False, 0
        while not ended:
            ready = [(-(-(k[s] + 1) * total // parts[s]), s) for s in left if k[s] * total // parts[s] <= now and k[s] < left[s]]
            deadline, s = min(ready)
            assert now < deadline
            order.append((s, done[s] + k[s]))
            k[s] += 1
            now += 1
            ended = k[s] == left[s]
        for s, n in k.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return order


@pytest.mark.parametrize("limit", [10**6, 0])
def test_mix_is_the_schedule_slot_by_slot(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    sizes = {"a": 130, "b": 130, "c": 57, "d": 1, "": 23}
    weights = {"a": 0.3, "b": 0.3, "c": 0.37, "d": 0.0, "": 0.03}  # ties, and a weight of 0
    rows = [(i, s or None) for s, n in sizes.items() for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4).collect()
    order = brute_mix(sizes, mixing.to_parts(weights), 4)
    assert {(x.slot, x.source or "", x.block) for x in got} == {(t, s, b) for t, (s, b) in enumerate(order)}


def test_mix_spreads_rows_without_doc_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    seen = {}
    write = mixing.materialize

    def kept(df, label):
        seen[label] = write(df, label)
        return seen[label]

    monkeypatch.setattr(mixing, "materialize", kept)
    docs = spark.createDataFrame([(None, "hot")] * 1000, "doc_id long, source string")
    got = mixing.mix(docs, block_rows=4).collect()
    assert len({(x.slot, x.pos) for x in got}) == 1000
    assert seen["dealt"].groupBy("bucket").count().agg({"count": "max"}).first()[0] < 150

"""Each operator on small rows: nulls, empty and long texts, repeated rows, empty tables, clashing columns, brute force."""

from __future__ import annotations

import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from saleskiln.llm import byte_bpe, components, decontaminate, html_extract, langid, line_quality, line_spread, minhash, pii, token_counts, toxicity
from saleskiln.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    base = prose(120)
    near = [base.replace(" ", f" x{k} ", 1) for k in range(6)]
    loose = [" ".join(w if rng.random() > 0.08 else f"y{k}" for k, w in enumerate(base.split())) for _ in range(12)]
    edge = [None, "", " \n\t ", "é", "a b c", "A B C", "<|endoftext|> x", "🎉 漢字  \u0085\x1c z", "x" * 5000, "a\n\n\nb.", prose(9000)]
    return [base, base, base.upper(), *near, *loose, *edge, *[prose(rng.randint(1, 60)) for _ in range(20)]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 12}", 0) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id here", None, None, None), rows[3]], SCHEMA)


def shingles(text):
    found = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def classes(rows, percent):
    sets = {k: shingles(t) for k, t in rows}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(sets[k]), label[k]) for k in sets}


@pytest.mark.parametrize("percent", [85, 70])
def test_near_duplicates_against_all_pairs(docs, texts, percent):
    found = minhash.near_duplicates(docs.withColumn("component_id", F.lit("clash")), percent=percent).collect()
    assert len(found) == len(texts) + 2
    expected = classes(list(enumerate(texts)), percent)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("percent", [70, 85])
def test_leftover_pairs_lose_no_link_and_spare_near_misses(spark, percent):
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(120)]

    def edited(edits):
        words = list(passage)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**9)}"
        return " ".join(words)

    made = [edited(rng.choice([1, 2, 3, 4, 8])) for _ in range(120)] + ["one two", "one two three", "", None]
    rows = [(k, text) for k, text in enumerate(made)] + [(0, made[1]), (3, made[3])]
    members = spark.createDataFrame([(k, k // 2 * 2) for k in range(len(made))], "node int, component int")
    texts = spark.createDataFrame(rows, "node int, text string").repartition(3)
    found = {(r.a, r.b) for r in minhash.leftover_pairs(members, texts, Scratch(spark), 5, percent).collect()}
    sets = [(k, shingles(text)) for k, text in rows]
    apart = [(a, b, x, y) for a, x in sets for b, y in sets if a < b and a // 2 != b // 2 and x and y]
    linked = {(a, b) for a, b, x, y in apart if 100 * len(x & y) >= percent * len(x | y)}
    assert linked and linked <= found and len(found) < len({(a, b) for a, b, *_ in apart})


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 4), (None, 4)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in components.components(frame, Scratch(spark)).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[k] == 100 for k in range(100, 160))
    assert components.components(frame.limit(0), Scratch(spark)).count() == 0


def test_collision_rate_matches_draws():
    import numpy as np

    rng, order, same = np.random.default_rng(5), minhash.loan_order(), 0
    for _ in range(60):
        a, b = (minhash.registers_of(np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64)), order) for _ in range(2))
        same += (a == b).sum()
    assert abs(same / (60 * minhash.BUCKETS) - minhash.collision_rate(np.array([2000.0]), np.array([2000.0]))[0]) < 6e-4


def test_bpe_equals_the_library(docs, texts):
    ranks = byte_bpe.read_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.bpe_round_trip(docs.withColumn("ids", F.lit(1))).collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    bpe, rng = byte_bpe.PrefixBPE(ranks), random.Random(8)
    piece = byte_bpe.PieceEncoder(bpe)
    for part in ("unbe", "liev", "", "able", "ness" * 9):
        piece.append(part.encode())
        assert piece.ids() == bpe.encode_piece(piece.data)
    for _ in range(150):
        text = "".join(rng.choice(["ab", "the ", "  ", "\n", "'ll", "9", "é", "!"]) for _ in range(40))
        edited = byte_bpe.EncodedText(bpe, text)
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.randint(0, 5))
        edited.edit(a, b, " new")
        assert edited.ids() == library.encode_ordinary(text[:a] + " new" + text[b:])


def test_token_counts_splice_exactly(docs):
    counter = token_counts.Counter()
    for chunk, overlap in ((100, 4), (token_counts.CHUNK, token_counts.OVERLAP)):
        for r in token_counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect():
            assert r.n_tokens == counter.whole(r.text or "") and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 512)
    small = token_counts.Counter(chunk=64, overlap=2)
    text = "word " * 20 + "x" * 300 + "<|endoftext|>" * 9 + " \n" * 80 + "end"
    assert small.count([text]) == [counter.whole(text)] and small.widened


def brute_hits(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            part = w[k : k + size]
            for at in range(len(own) - len(part) + 1):
                if own[at : at + len(part)] == part:
                    hit.update(range(at, at + len(part)))
                    found.add(item)
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 300])
def test_contamination_against_brute_force(spark, docs, texts, block_bytes):
    base = texts[0].split()
    items = [(1, " ".join(base[20:45])), (2, ", ".join(base[30:50]).upper()), (3, "a-b C"), (4, None), (5, "?!"), (6, " ".join(base[:10]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for r in decontaminate.find_contamination(docs, benchmark, block_bytes=block_bytes).collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, items) and r.contaminated == (r.n_hit > 0)
        for s in r.spans:
            assert len(decontaminate.words_of(r.text[s.start : s.stop])) == s["last"] - s["first"] + 1
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_line_quality_on_rows(docs, texts):
    for r in line_quality.clean_lines(docs.withColumn("kept", F.lit(3))).collect():
        words = re.findall(WORD, r.text or "")
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        again = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(windows) < 400 else None
        assert r.n_words == len(words) and (again is None or r.n_repeat_words == len(again))
        assert r.kept is False or not r.base_failed


def test_spread_lines_stay_once(spark):
    rows = [(k, f"own line {k}.\n  Shared line. \n\n", f"s{k % 12}") for k in range(30)] + [(99, None, "s1"), (98, "", None), (None, "Shared line.", "s3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in line_spread.drop_spread_lines(docs).collect()}
    assert found[0].text == rows[0][1] and found[99].text is None and found[98].text == "" and found[None].text == "Shared line."
    assert all(found[k].text == f"own line {k}.\n\n" and (found[k].n_lines, found[k].n_removed) == (2, 1) for k in range(1, 30))
    for sites, removed in ((9, 0), (10, 9)):
        few = docs.where(F.col("doc_id") < sites)
        assert line_spread.drop_spread_lines(few).agg(F.sum("n_removed")).first()[0] == removed
    assert line_spread.drop_spread_lines(docs.limit(0)).count() == 0


def test_language_model(spark, docs):
    de, en = "der und die nicht schön über straße", "the and with which this that would"
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice((de, en)[k % 2].split()) for _ in range(12)), ("de", "en")[k % 2]) for k in range(120)]
    model = langid.train_languages(spark.createDataFrame([*rows, (500, None, "de"), (501, "x", None)], "doc_id bigint, text string, lang string"))
    asked = spark.createDataFrame([(1, "Die Straße und der"), (2, "THE AND THIS"), (3, None), (4, ""), (5, "12 !?")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in langid.identify_language(asked.withColumn("score", F.lit(9)), model).collect()}
    assert (found[1].lang_pred, found[2].lang_pred) == ("de", "en") and all(found[k].lang_pred == "und" and found[k].rejected for k in (3, 4, 5))
    assert langid.train_languages(docs.limit(0)) is None and langid.identify_language(asked, None).where("rejected").count() == 5


def test_every_language_is_learnt(spark):
    rng = random.Random(21)
    words = {f"l{k:03d}": [chr(0x4E00 + 40 * k + j) * 2 for j in range(12)] for k in range(230)}
    rows = [(code, " ".join(rng.choice(w) for _ in range(10))) for code, w in words.items() for _ in range(10 if code < "l200" else 6)]
    rows.append(("only", " ".join("ßßöö" for _ in range(10))))
    model = langid.train_languages(spark.createDataFrame([(k, t, code) for k, (code, t) in enumerate(rows)], "doc_id bigint, text string, lang string"))
    assert sorted(model.languages) == [*sorted(words), "only"]
    chances, _ = model.scores([" ".join(w) for w in words.values()], langid.letter_table())
    named = [model.languages[k] for k in chances.argmax(axis=1)]
    assert sum(a == b for a, b in zip(named[200:], list(words)[200:])) >= 27
    few = langid.fit([(langid.np.array([5], "int32"), langid.np.array([2], "int32"), "one")], ["one"])
    assert few.scores(["abc"], langid.letter_table())[0].shape == (1, 1)


def test_segments_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        values = [rng.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 3.0]) for _ in range(rng.randint(1, 25))]
        found = toxicity.maximal_segments(values)
        best = max((sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=0)
        assert max((s for *_, s in found), default=0.0) == pytest.approx(max(best, 0.0))
        assert all(sum(values[a:b]) == pytest.approx(s) for a, b, s in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_toxicity_learns_and_takes_edges(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    bad = lambda k: k % 8 == 0
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)) + (" you vilething" if bad(k) else "")) for k in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(bad(k))) for k in range(300)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()}
    assert all((found[k].score >= 0.3) == bad(k) for k in range(300, 400)) and found[900].score == found[901].score < 0.3
    assert toxicity.train_toxicity(docs, labels.where("toxic = 0")) is None
    assert toxicity.score_toxicity(docs, None).where("score > 0").count() == 0


def test_pseudonyms_keep_format_link_and_go_back(spark):
    card, text = "4111 1111 1111 1111", "Mail a.b7@x.org or +1 (988) 555-2485, ssn 123-45-6789, card {}, IBAN GB82 WEST 1234 5698 7654 32, 10.1.2.3 on 2020-02-29."
    rows = [(1, text.format(card)), (2, "again 4111-1111-1111-1111!"), (3, "4111 1111 1111 1112 and 2020-02-30"), (4, None), (5, ""), (6, "clean text.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    named = pii.pseudonymise(docs.withColumn("entities", F.lit(0)), key="k")
    found = {r.doc_id: r for r in named.collect()}
    assert [e.kind for e in found[1].entities] == ["email", "phone", "ssn", "card", "iban", "ip", "date"]
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(found[1].entities[3].pseudonym) == digits(found[2].entities[0].pseudonym) != digits(card)
    assert pii.luhn_digit(digits(found[2].text)[:-1]) == digits(found[2].text)[-1]
    assert all(found[k].text == rows[k - 1][1] and not found[k].entities for k in (3, 4, 5, 6))
    back = {r.doc_id: r.text for r in pii.pseudonymise(named, key="k", back=True).collect()}
    assert back == dict(rows)
    for size in (1, 2, 7, 100, 1001):
        network = pii.Feistel("k", "t", size)
        assert sorted(map(network.permute, range(size))) == list(range(size)) and all(network.permute(network.permute(v), True) == v for v in range(size))


def spans_of(text):
    names, back = pii.Pseudonyms("k"), pii.Pseudonyms("k", True)
    changed, spans = names.replace(text)
    assert back.replace(changed)[0] == text
    return [(kind, text[a:b]) for a, b, kind, _ in spans]


def test_pseudonyms_retry_behind_failed_candidates():
    assert spans_of("555-123-4567 2024") == [("phone", "555-123-4567")]
    assert spans_of("555-123-4567 555-123-4568") == [("phone", "555-123-4567"), ("phone", "555-123-4568")]
    for tail in (" EUR", " EURO", " 2024", " EUR 2024 AND MORE"):
        assert spans_of(f"BE68539007547034{tail}") == [("iban", "BE68539007547034")]
        assert spans_of(f"to BE68 5390 0754 7034{tail}") == [("iban", "BE68 5390 0754 7034")]
    assert spans_of("GB82 WEST 1234 5698 7654 32 GBP") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert spans_of("AB12 CDEF 4111111111111111") == spans_of("1 4111111111111111") == [("card", "4111111111111111")]
    assert spans_of("4111 1111 1111 1111 20 2020-12-25") == [("card", "4111 1111 1111 1111"), ("date", "2020-12-25")]
    assert spans_of("7 123-45-6789 000-12-3456") == [("ssn", "123-45-6789")]
    assert spans_of("2020-02-30 2020-02-29") == [("date", "2020-02-29")]
    assert spans_of("4111 1111 1111 1111.bob@x.org") == [("email", "1111.bob")]
    rng = random.Random(9)
    values = {"phone": lambda: f"{rng.randint(200, 999)}-{rng.randint(100, 999)}-{rng.randint(0, 9999):04d}", "card": lambda: (p := f"4{rng.randrange(10**14):014d}") + pii.luhn_digit(p)}
    for _ in range(300):
        planted = [(kind, values[kind]()) for kind in rng.choices(list(values), k=3)]
        assert spans_of(" ".join(v for _, v in planted)) == planted


def test_pseudonyms_take_all_addresses_date_orders_and_phone_forms():
    for kind, values in {
        "ip": ["248.40.198.62", "233.254.104.120", "0.0.0.0", "127.0.0.1", "255.255.255.255", "10.1.2.3"],
        "date": ["25/12/2020", "12/25/2020", "05/06/2020", "25-12-2020", "12-25-2020", "05-06-2020", "25.12.2020", "2020-12-25"],
        "phone": ["555 123 4567", "1-800-555-0199", "1 800 555 0199", "1.800.555.0199", "1-(800) 555-0199", "555-123 4567", "+1 (988) 555-2485"],
    }.items():
        for value in values:
            assert spans_of(f"at {value}, so") == spans_of(value) == [(kind, value)]
        assert spans_of(" or ".join(values)) == [(kind, v) for v in values]
    names = pii.Pseudonyms("k")
    assert names.replace("010.001.002.003")[1] and not names.replace("256.1.1.1 1.2.3.4.5 31/02/2020 13-13-2020 1234 5678")[1]
    first, second, iso = (names.replace(v)[0] for v in ("12/25/2020", "25/12/2020", "2020-12-25"))
    assert first.split("/") == [second.split("/")[k] for k in (1, 0, 2)] == [iso.split("-")[k] for k in (1, 2, 0)]


def test_pseudonyms_take_whole_secrets():
    rng = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    part = lambda n: "7" + "".join(rng.choices(letters, k=n - 2)) + "z"
    jwt = f"eyJhbGciOiJIUzI1NiJ9.{part(300)}.{part(43)}"
    for value in ("hunter22", part(64), part(65), part(201), part(1000), jwt, f"{part(20)}={part(20)}", "0a1b" * 60, "2020-12-25-abcdefgh", "Zz9" * 30):
        for text in (f"token={value}", f'my password: "{value}". End.', f"secret: password: {value}, x", f"api_key = {value}=="):
            assert spans_of(text) == [("secret", value)]
    a, b = (pii.Pseudonyms("k").replace(f"token={v}")[0] for v in ("x1" * 300, "x1" * 299 + "x2"))
    assert len(a) == len(b) and all(sum(x != y for x, y in zip(a[k : k + 60], b[k : k + 60])) > 30 for k in range(6, 600, 60))
    plain = "q7" * 300
    hidden = pii.Pseudonyms("k").replace(f"token={plain}")[0][6:]
    assert all(sum(x != y for x, y in zip(hidden[k : k + 60], plain[k : k + 60])) > 30 for k in range(0, 600, 60))
    assert pii.Pseudonyms("k").replace("token: short1 secret=nodigitshere.")[1] == []


def test_main_text(spark):
    page = "<html><body><nav><ul><li><a href=/x>Menu one</a></li></ul></nav><div class=ad>Buy this now.</div><article><h1>Title {k}</h1><p><b>First &amp; best\n part {k} of the story.<br><p>Second part, which is longer than the first one {k}.</article><footer>&copy; foot.</footer></body>"
    rows = [(k, "u", page.replace("{k}", str(k))) for k in range(60)]
    pages = spark.createDataFrame([*rows, (100, "u", None), (101, "u", ""), (102, "u", "<p>unclosed < text</"), (103, "u", "<div>" * 3000 + "deep.")], "page_id bigint, url string, html string")
    found = {r.page_id: r for r in html_extract.extract_main_text(pages.withColumn("text", F.lit("old")), html_extract.train_extractor(pages)).collect()}
    for k in range(60):
        assert found[k].text == f"Title {k}\n\nFirst & best part {k} of the story.\n\nSecond part, which is longer than the first one {k}." and found[k].n_chars == len(found[k].text)
    assert found[100].text == found[101].text == "" and html_extract.train_extractor(pages.limit(0)) is None
    kept = html_extract.decode([-1, 0, 1, 0], __import__("numpy").array([1.0, -5.0, 2.0, 1.0]))
    assert kept.tolist() == [True, False, False, True]


def test_main_text_behind_and_in_embedded_parts(spark):
    long = "This is part {k} of the story, and it is long enough to be told from a menu."
    page = "<html><body><nav><ul><li><a href=/x>Menu one</a></li></ul></nav><article><h1>Title {k}</h1><p>" + long + "</p><p>" + long + "</p></article><footer>foot.</footer></body>"
    pages = spark.createDataFrame([(k, "u", page.replace("{k}", str(k))) for k in range(60)], "page_id bigint, url string, html string")
    a, b, c = (long.replace("{k}", k) for k in ("one", "two", "three"))
    around = lambda part: f"<html><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav><article><p>{a}</p>{part}<p>{b}</p></article><footer>foot.</footer></body>"
    lost = ["<svg class=i/>", "<svg class='i' />", "<math/>", "<button>", "<select>", "<object>", "<video src=x>", "<canvas>", "<noscript>", "<iframe src=x>", "<audio>", "<template>"]
    whole = [around(p) for p in [*lost, "<svg><title>Icon</title><path d='M0'/></svg>", "<video><source src=x></video>", "<svg/><svg><path/></svg>", "<iframe>old</iframe>"]]
    asked = [*whole, around(f"<object><p>{c}</p></object>"), around(f"<video>{c}</video>"), around("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, as <svg><path/></svg> says the story.</p>")]
    frame = spark.createDataFrame(list(enumerate(asked)), "page_id bigint, html string")
    found = {r.page_id: r.text for r in html_extract.extract_main_text(frame, html_extract.train_extractor(pages)).collect()}
    for k in range(len(whole)):
        assert found[k] == f"{a}\n\n{b}", asked[k]
    n = len(whole)
    assert found[n] == found[n + 1] == f"{a}\n\n{c}\n\n{b}" and found[n + 2] == f"{a}\n\nSo x=1 holds, as says the story.\n\n{b}"
    assert html_extract.parse("<p>a</p><script>x<p>b</p>").blocks == [(1, "a")]
    words = " ".join(t for _, t in html_extract.parse("<p>a<button>b<p>c</p></button><select><option>d<option>e</select><noscript>f</noscript>").blocks)
    assert words == "a b c d e f"

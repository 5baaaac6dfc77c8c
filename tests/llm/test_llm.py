"""The operators against libraries, brute force and hand-made rows (nulls, empty texts, ties, repeated rows)."""

import collections
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from wavestat.llm import decontaminate, html, language, licences, pieces, ppm, pseudonyms, quality, sharding, simhash

SF = "/root/testdata/sf0.001"
ROWS = [(1, "The cat sat on the mat and the dog lay down. " * 3, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
        (3, "", "en", "a", 0), (4, " \n\t ", "de", "b", 4), (None, "Mail bob.12@mail1.example.com or +1 (415) 555-2671 now", "en", "b", 9),
        (5, "card 4111111111111111 and 4111 1111 1111 1111 but 4111111111111112, on 2021-03-04 from 10.1.2.3", "en", "a", 9),
        (6, "x" * 5000, "fr", "a", 5000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def sample():
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()


def test_repeated_words_against_counting(sample):
    for _, text, _ in sample[:80]:
        w = text.encode().split()
        n = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        want = {j for i in range(len(w) - 7) if n[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.statistics(text.encode())[4] == len(want)


def test_forest_keeps_signs_and_flat_scores():
    rng = np.random.default_rng(1)
    x = rng.random((600, 9))
    y = ((x[:, 0] < 0.5) ^ (rng.random(600) < 0.1)).astype(float)
    model = quality.fit(x, y)
    low = model.score(x)
    for j in range(3):
        up = x.copy()
        up[:, j] += 0.3
        assert (model.score(up) <= low + 1e-12).all()
    assert ((low > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95


def test_quality_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(ROWS) and all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert quality.judged(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_sharding_is_even_and_mixed(spark):
    rows = [(i, f"t{i % 7}", "hot" if i % 3 else f"s{i % 11}") for i in range(997)] + [(5, None, None)] * 3
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8).collect()
    assert len(got) == 1000
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    assert all(len(v) == 125 and sorted(r.slot for r in v) == list(range(125)) for v in per.values())
    hot = sum(r.source == "hot" for r in got)
    assert all(abs(sum(r.source == "hot" for r in v) - hot / 8) <= 2 for v in per.values())
    assert {r.text_crc32 for r in got if r.source is None} == {0}


def test_pieces_equal_the_library(spark, docs, sample):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for _, t, _ in sample] + ["", " ", "a\n b", "▁x", "  hi   there  ", "é 日本🙂", "\x00\t", "<s> <0x0A>",
                                        "a" * 999 + " " + "ab" * 700, " " * 50 + "y", "\n\n", "thethe" * 90]
    for text, (n, ids, back) in zip(texts, pieces.Pieces(path).encode(texts), strict=True):
        want = sp.encode(text)
        assert (n, ids, back) == (len(want), ",".join(map(str, want)), sp.decode(want))
        assert pieces.Pieces.decode(pieces_model(path), want) == back
    assert pieces.encoded(docs, path).count() == len(ROWS)


_MODELS: dict = {}


def pieces_model(path):
    return _MODELS.setdefault(path, pieces.Pieces(path))


def test_language_held_out(sample):
    learn = [(t, k) for i, t, k in sample if zlib.crc32(str(i).encode()) % 5]
    content = collections.defaultdict(bytes)
    for t, k in learn:
        content[k] += language.letters(t)
    judge = language.Judge({k: v[:language.DICT_BYTES] for k, v in content.items()})
    held = [(t, k) for i, t, k in sample if zlib.crc32(str(i).encode()) % 5 == 0 and len(t) > 60]
    assert np.mean([judge(t)[0] == k for t, k in held]) > 0.9
    assert judge(None) == judge("12 !?") == ("und", 0.0, False)


def test_language_without_a_letter():
    judge = language.Judge({"de": b" der die und ", "en": b" the of and "})
    assert [judge(t)[0] for t in (None, "", "123 _!", "\u00bd", "\u00b2 \u2460")] == ["und"] * 5
    assert language.letters("a\u00b2b \u00bd C") == b" ab c "


def test_ppm_against_a_direct_trie(spark):
    rows = [(i, t) for i, t in enumerate(["Banana band", "ban the band", "the banana", "a", "", None, "zebra ban", "the the"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.scored(docs, ppm.remainder("doc_id", 7) == 2).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    trie = collections.defaultdict(collections.Counter)
    words = collections.Counter()
    for t in train:
        words.update([*(t or "").lower().encode().split(), None])
        s = b"\xff" * 5 + (t or "").lower().encode() + b"\xff"
        for k in range(5, len(s)):
            for n in range(6):
                trie[s[k - n:k]][s[k]] += 1
    total = sum(words.values())
    for i, t in rows:
        s, score = b"\xff" * 5 + (t or "").lower().encode() + b"\xff", 0.0
        for k in range(5, len(s)):
            gone: set = set()
            for n in range(5, -1, -1):
                live = {c: v for c, v in trie[s[k - n:k]].items() if c not in gone}
                whole = sum(live.values()) + len(live)
                if s[k] in live:
                    score += math.log10(live[s[k]] / whole)
                    break
                if live:
                    score += math.log10(len(live) / whole)
                gone |= set(trie[s[k - n:k]])
            else:
                score -= math.log10(256 - len(gone))
        own = [*(t or "").lower().encode().split(), None]
        base = sum(math.log10((words[w] + 1) / (total + len(words) + 1)) for w in own)
        assert got[i].score == pytest.approx(score) and got[i].base_score == pytest.approx(base)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(words[w] > 0 for w in own), total)


def test_ppm_does_not_depend_on_the_blocks(spark, docs):
    text = "the quick brown fox jumps over the lazy dog and the cat \x0b sat\n"
    rows = [(i, text[i % 11:] * (i % 5) + str(i)) for i in range(60)] + [(None, "the same"), (None, "the same"), (60, "x " * 4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))

    def scores(**size):
        return sorted(map(repr, (tuple(round(x, 6) if isinstance(x, float) else x for x in r)
                                 for r in ppm.scored(table, ppm.remainder("doc_id", 7) == 2, **size).collect())))

    assert len(scores()) == len(rows) + len(ROWS) and scores() == scores(block_bytes=900)
    assert ppm.scored(docs.limit(0).withColumn("block", docs["n_words"]), ppm.remainder("doc_id", 7) == 2).collect() == []


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark, docs):
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs).collect()}
    text, kinds = got[5].text, got[5].kinds
    assert kinds == ["card", "card", "date", "ip"] and "4111111111111112" in text
    one, two = text.split()[1], "".join(text.split()[3:7])
    assert one == two != "4111111111111111" and luhn(one) and "2021-03-04" not in text and "10.1.2.3" not in text
    mail = got[None].text.split()
    assert mail[1].endswith("@mail1.example.com") and "bob.12" not in mail[1] and "555-2671" not in got[None].text
    assert got[1].text == ROWS[0][1] and got[2].text is None and got[6].text == ROWS[-1][1]


def test_pseudonyms_beside_other_numbers(spark):
    card, grouped, iban, phone = "4111111111111111", "4111 1111 1111 1111", "AT611904300234573201", "+1 (415) 555-2671"
    texts = [card, f"{card} 123", f"row 12 {card} 7", f"{grouped} 123 x", f"12 {grouped} 22", f"{card} {card} 9", f"{grouped} {grouped}",
             iban, f"{iban} EUR", f"{iban} 2024 x", f"{iban} {card}", "AT61 1904 3002 3457 3201 1234",
             phone, f"{phone} 2024 12", f"{phone} 2024", "+1 415 555 2671 2024", f"{phone} {phone}", f"{phone} {card} 7",
             f"{card} 12 a.b@c.de", f"{card} JOE.12@x.com", f"({card}) ({card})", "411 11111 11111 111", f"{card} 2021-03-04 10.1.2.3",
             "7 " * 3000 + card]
    got = [r.text for r in pseudonyms.pseudonymised(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    c, i, p = got[0], got[7], got[12]
    g = " ".join(c[k:k + 4] for k in range(0, 16, 4))
    assert c != card and luhn(c) and i != iban and p != phone
    assert got[1:7] == [f"{c} 123", f"row 12 {c} 7", f"{g} 123 x", f"12 {g} 22", f"{c} {c} 9", f"{g} {g}"]
    assert got[8:12] == [f"{i} EUR", f"{i} 2024 x", f"{i} {c}", " ".join(i[k:k + 4] for k in range(0, 20, 4)) + " 1234"]
    assert got[13:18] == [f"{p} 2024 12", f"{p} 2024", p.replace("(", "").replace(")", "").replace("-", " ") + " 2024", f"{p} {p}", f"{p} {c} 7"]
    assert got[18].startswith(f"{c} 12 ") and "a.b@" not in got[18] and got[19].startswith(f"{c} ") and "JOE.12" not in got[19]
    assert got[20] == f"({c}) ({c})" and got[21].replace(" ", "") == c
    assert got[22].startswith(f"{c} ") and "2021-03-04" not in got[22] and "10.1.2.3" not in got[22] and got[23] == "7 " * 3000 + c


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F
    two = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert two.select(pseudonyms.feistel(F.col("v"), F.lit("t"))).distinct().count() == 1000
    days = spark.range(146097).select(pseudonyms._number(F.col("id"), 27, 5411, "date", "k").alias("d"))
    assert days.distinct().count() == 146097


def test_html_blocks():
    tree = html.trained()
    page = ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><header>Site</header>"
            "<div class='cookie-notice'>We use cookies</div><article><h1>Big &amp; news</h1><p>One   two<br>three four five six"
            " seven eight nine ten<p>Last.<form>Name <input></form></article><aside>More</aside>"
            "<div id=comments><p>Great text, thank you very much for it all</p></div><footer>&copy; me</footer><script>x('</p>')</script>")
    assert html.main_text(page, tree) == "Big & news\nOne two three four five six seven eight nine ten\nLast."
    assert html.main_text(None, tree) == html.main_text("", tree) == html.main_text("<p", tree) == ""


def test_html_without_landmarks():
    tree = html.trained()
    used = set()

    def walk(t):
        if not isinstance(t, int):
            used.add(html.NAMES[t[0]])
            walk(t[2])
            walk(t[3])

    walk(tree)
    assert {"words", "links", "before_links", "after_links"} <= used
    long = [" ".join(f"{w}{k}" for k in range(n)) + "." for w, n in (("one", 45), ("two", 60), ("three", 38))]
    nav = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in ("Home", "About us", "Contact")) + "</ul>"
    body = f"<h1>Title here</h1><p>{long[0]}</p><p>Yes.</p><p>{long[1]}</p><ul><li>two</li></ul><p>{long[2]}</p>"
    want = "\n".join(["Title here", long[0], "Yes.", long[1], "two", long[2]])
    assert html.main_text(f"<body>{body}</body>", tree) == want
    assert html.main_text(f"<body>{nav}{body}{nav}</body>", tree) == want
    assert html.main_text("<p>One short paragraph.</p>", tree) == "One short paragraph."
    ad = f'<div class="newsletter-signup"><p>Subscribe to our newsletter now {long[0]}</p></div>'
    assert html.main_text(f"<body>{body}{ad}</body>", tree) == want
    named = [f'<p class="share-price">{long[0]}</p>', f'<p id="search-algorithms">{long[1]}</p>', f'<p class="tags-explained">{long[2]}</p>']
    assert html.main_text(f"<body>{nav}<article>{''.join(named)}{ad}</article>{nav}</body>", tree) == "\n".join(long)
    assert html.main_text("", tree) == html.main_text(None, tree) == html.main_text(nav, tree) == ""


def test_simhash_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2**63, 2**63, 40)
    prints = {0}
    for b in base.tolist():
        for _ in range(6):
            x = b
            for k in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                x ^= -2**63 if k == 63 else 1 << k
            prints.add(x)
    prints = sorted(prints)
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for chain in (2, 3):
        assert {tuple(r) for r in simhash.links(df, chain=chain).collect()} == want
    root = {p: p for p in prints}
    for _ in prints:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(simhash.components(df.sparkSession.createDataFrame([*want], "a long, b long")).collect())
    assert all(got.get(p, p) == root[p] for p in prints)


def test_simhash_fingerprint_and_rows(spark, docs):
    text = b"A b c D e f"
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d", b"b c d e", b"c d e f")]
    want = sum((sum(h >> k & 1 for h in hashes) * 2 > 3) << k for k in range(64))
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]


def test_decontamination_finds_planted_items(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame(
        [(None, None, "en", "x", 0), (-1, "", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    items = [(r.item_id, decontaminate.words(r.text.encode())) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        w = b" ".join(decontaminate.words((r.text or "").encode()))
        want |= {(r.doc_id, i) for i, x in items if b" ".join(x) in w}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).where("contaminated").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want) + 1
    assert decontaminate.common_words([b"a", b"b", b"c", b"a"], [b"b", b"x", b"c", b"a"]) == 3
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench).count() == docs.count() - len({d for d, _ in got})


def prose(rng, n, words=900):
    """Words of invented prose: half of them from twelve common ones."""
    return [f"w{k}" if k < 12 else f"v{rng.integers(words)}" for k in rng.integers(0, 24, n)]


def test_decontamination_finds_items_in_long_texts(spark):
    rng = np.random.default_rng(5)
    items = [prose(rng, 22) for _ in range(40)]
    texts = [prose(rng, 1200) for _ in range(160)]
    for i, item in enumerate(items):
        at = 100 + 7 * i
        texts[i][at:at] = item
        texts[40 + i][at:at] = [f"other{i}" if k % 5 == 2 else w for k, w in enumerate(item)]  # a paraphrase: every fifth word
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id int, text string")
    want = {(r.doc_id, r.item_id): r.lcs_share for r in decontaminate.matches(docs, bench, None).where("contaminated").collect()}
    assert all(want.get((i, i)) == 1.0 and want.get((40 + i, i), 0) >= 0.75 for i in range(40))
    got = {(r.doc_id, r.item_id): r.lcs_share for r in decontaminate.matches(docs, bench).where("contaminated").collect()}
    assert all(got.get((i, i)) == 1.0 for i in range(40))
    assert sum((40 + i, i) in got for i in range(40)) >= 36 and all(got[k] <= want[k] for k in got)


def test_decontamination_against_brute_force(spark):
    """LCS and the answer by plain tables over whole short texts; every passage a candidate."""
    rng = np.random.default_rng(8)
    items = [prose(rng, n) for n in (10, 15, 22, 30, 70)]
    texts = [prose(rng, 40) for _ in range(60)]
    for k, t in enumerate(texts[:30]):
        item = items[k % 5]
        t[20:20] = [w for w in item if rng.random() < 0.5 + k / 60]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i if i else None, " ".join(t)) for i, t in enumerate(items)], "item_id int, text string")

    def subsequence(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(rows[-1][j] + 1 if x == y else max(row[-1], rows[-1][j + 1]))
            rows.append(row)
        return rows[-1][-1]

    got = {(r.doc_id, r.item_id or 0): r for r in decontaminate.matches(docs, bench, None).collect()}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            r = got.get((i, j))
            part = t[r.first_word:r.end_word] if r else []
            if r:
                assert r.lcs_share == subsequence(item, part) / len(item) and r.lcs_share >= 0.5
            whole = subsequence(item, t) / len(item)
            assert not r or r.lcs_share <= whole
            if i < 30 and j == i % 5 and whole >= 0.7:
                assert r.contaminated and r.lcs_share == whole
    assert any(r.item_id is None for r in got.values())
    found = {d for (d, _), r in got.items() if r.contaminated}
    assert {*range(60)} - {r.doc_id for r in decontaminate.clean(docs, bench).collect()} <= found


def test_stages_with_clashing_columns(spark):
    """Columns with the names that helpers would take stay as they are."""
    more = ["_key", "_id", "_h", "_own", "_bad", "_row", "_new", "_found", "_Key2"]
    docs = spark.createDataFrame([(1, "call +1 (415) 555-2671 now please", *"abcdefghi"), (2, "another text of words here", *"abcdefghi"),
                                  (2, "another text of words here", *"abcdefghi"), (None, None, *[None] * 9)],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in more))
    bench = spark.createDataFrame([(None, "another text of words here")], "item_id int, text string")
    once = simhash.deduplicated(docs)
    assert once.columns == docs.columns and {(r.doc_id, r._found) for r in once.collect()} == {(1, "h"), (2, "h"), (None, None)}
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and {(r.doc_id, r._row) for r in left.collect()} == {(1, "f"), (None, None)}
    safe = pseudonyms.replaced(docs).select(docs.columns).collect()
    assert len(safe) == 4 and all(r._new in ("g", None) and "555-2671" not in (r.text or "") for r in safe)
    for stage in (simhash.deduplicated, lambda d: decontaminate.clean(d, bench), pseudonyms.replaced):
        assert stage(docs.limit(0)).count() == 0


def test_decontamination_basis_is_of_all_documents(spark):
    docs = spark.range(2600).selectExpr("id as doc_id", "concat('only', id) as text")
    basis = decontaminate.fitted(docs)[1]
    hashes = decontaminate.Hashes()
    assert all(np.abs(basis[decontaminate._features(hashes(b"only%d" % i))]).max() > 0 for i in range(2600))


def test_decontamination_keeps_clean_documents(spark):
    rng = np.random.default_rng(6)
    common = [[f"w{k}" for k in rng.integers(0, 12, 8)] for _ in range(30)]
    items = [prose(rng, 24) + ([f"end{i}", f"of{i}"] + c[2:] if i % 2 else c) for i, c in enumerate(common)]
    items.append([f"q{k}" for k in range(14)] + [f"a{k}" for k in range(8)])
    texts = [prose(rng, 300) for _ in range(200)]
    leak = items[-1][:6] + texts[0][:40] + items[-1][-8:]  # 14 of 22 words, the answer among them
    apart = items[-1][:6] + [w for a in items[-1][-8:] for w in (a, *texts[1][:4])]  # the same words, the answer's far apart
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, leak, apart])], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id int, text string")
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {*range(200), 201}


def test_licences():
    model = licences.Model(["The cat sat on the mat", "Of the version of this work", "Another line of plain words"])
    for family, texts in licences.TEMPLATES.items():
        assert model(licences.tokens(texts[0]))[0] == family
    assert model(licences.tokens("You need a driving license to rent a car."))[0] == licences.UNKNOWN


def test_licence_scan_reads_each_word_once(monkeypatch):
    model = licences.Model(["The cat sat on the mat", "Of the version of this work", "Another line of plain words"])
    text = ("The cat sat\non the mat of the work\n\nReleased under the MIT\nLicense. The work is free\n"
            + "The terms of the work, and of the version. " * 6 + "\nof the software")
    words = [ws for parts in model.lines(text) for ws in parts] + [licences.tokens(text)]
    for ws in words:
        assert set(model.places(ws)) == {model.vocabulary[g] for g in licences.grams(ws) if g in model.vocabulary}
    read = []
    monkeypatch.setattr(licences, "tokens", lambda x, f=licences.tokens: read.extend(f(x)) or f(x))
    assert [(h[0], h[3], h[4]) for h in model.found(text)] == [(True, "mit", 3)]
    assert read == words[-1]


def test_licence_rows(spark, docs):
    assert licences.scanned(docs, licences.trained(docs)).count() == len(ROWS)


def test_licence_notices_over_several_lines(spark, docs):
    gpl = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as\n"
           "# published by the Free Software Foundation.\n")
    bsd = (" * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following"
           "\n * conditions are met:\n")
    one = "A plain line here.\nReleased under the MIT License.\nThe cat sat on the mat.\n"
    rows = [(1, "# Copyright 2020 Some One\n#\n" + gpl + "import os\n"), (2, bsd), (3, gpl + "\n" + bsd), (4, one)]
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string"), licences.trained(docs)).collect()}
    assert (got[1].family, got[1].verdict, got[1].line) == ("gpl", "confirmed", 2)
    assert (got[2].family, got[2].verdict) == ("bsd", "confirmed") and got[3].families == ["bsd", "gpl"]
    assert (got[4].line, got[4].families, got[4].n_paragraphs) == (1, ["mit"], 1)

import re
from collections import Counter

import pyarrow as pa
import pytest

from strataflow.llm import conv_quality, decontaminate, html_text, license_scan, quality_rules, quote_chat

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_quality_rules_against_brute_force(docs, rows, empty):
    got = quality_rules.score_documents(docs).collect()
    view = lambda r: (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert sorted(map(view, got)) == sorted((str(r[0]), *brute_rules(r[1])) for r in rows)
    assert all(not r.kept for r in got if r.base_failed) and all(r.zstd_ratio is None for r in got if r.n_words == 0 and r.word_chars == 0 and r.n_chunks == 0)
    kept = quality_rules.filter_documents(docs)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in got)
    assert quality_rules.score_documents(empty).count() == 0


def test_bands_follow_length_and_chunks():
    prose = "the quick brown fox jumps over one lazy dog and then rests in deep green grass near an old stone wall while birds sing about summer rain "
    assert quality_rules.band_verdict(len(prose), 0.66, 0, 1)
    assert not quality_rules.band_verdict(5000, 0.30, 0, 2) and not quality_rules.band_verdict(5000, 0.80, 0, 2)
    assert not quality_rules.band_verdict(5000, 0.46, 2, 3) and quality_rules.band_verdict(5000, 0.46, 0, 3)
    assert quality_rules.chunk_bounds(100) == [(0, 100)] and quality_rules.chunk_bounds(5000) == [(0, 2048), (2048, 5000)]


def test_leaks_against_brute_force(spark, docs, rows, empty):
    by_id = {r[0]: r[1] for r in rows}
    w = by_id[70 if 70 in by_id else 5].split()
    items = [(1, " ".join(by_id[5].split()[3:28])), (2, " ".join([*by_id[6].split()[:12], "zzz", *by_id[6].split()[13:30]])), (3, "one"), (4, None), (5, ""), (6, "One two three four"), (7, "nothing like this stands in any text here at all"), (1, " ".join(by_id[5].split()[3:28])), (8, " ".join(w[:20]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.find_leaks(docs, benchmark).collect())
    want = Counter()
    for r in rows:
        d = WORD.findall((r[1] or "").translate(LOW))
        for item, text in items:
            t = WORD.findall((text or "").translate(LOW))
            if not t or len(d) < min(5, len(t)):
                continue
            k = min(5, len(t))
            grams = lambda x: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]  # noqa: E731, B023
            dg, tg = grams(d), Counter(grams(t))
            m = min(len(dg), len(t) - k + 1)
            best = max((sum((Counter(dg[s : s + m]) & tg).values()) for s in range(len(dg) - m + 1)), default=0)
            similarity = best / (m + len(t) - k + 1 - best)
            if similarity >= 0.8:
                want[r[0], item, round(similarity, 9)] += 1
    assert got == want and want
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.schema == docs.schema and clean.count() == len(rows) - sum(any((r[0], i) in {k[:2] for k in want} for i in range(9)) for r in rows)
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.find_leaks(empty, benchmark).count() == 0


def test_leaks_of_few_or_repeated_ngrams_are_all_found():
    texts, docs = [], []
    for i in range(1500):
        words = [f"w{i}x{j}" for j in range(9)]
        texts.append(" ".join(words))
        docs.append(" ".join(words[:8]))  # 4 of 5 n-grams
    for i in range(40):
        cycle = [f"c{i}x{j % 4}" for j in range(13)]
        texts.append(" ".join([*cycle, "end"]))
        docs.append(" ".join([*cycle, "other"]))  # 9 of 10 n-grams, repeated
    found = {(row, item) for row, item, *_ in decontaminate.Items(list(range(1540)), texts).matches(pa.array(docs))}
    assert len(found) == 1540 and all(row == item for row, item in found if item < 1500)


def test_leaks_do_not_depend_on_benchmark_blocks(spark, docs, rows):
    items = [(i, r[1]) for i, r in enumerate(rows[:20]) if r[1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one = sum(len(b.ids) for b in decontaminate.item_blocks(benchmark))
    many = list(decontaminate.item_blocks(benchmark, chars=900))
    assert len(many) > 2 and sum(len(b.ids) for b in many) == one


def test_pages(spark):
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>menu</a></li></ul></nav>
    <div class="ad">Buy now</div><article><h1>Title &amp; more</h1><p><b>First\n paragraph<br>goes on.<p>Second&nbsp;one</p><aside>side</aside><p>Third</p><ul><li>a</li><li>b</li></ul></article>
    <div id="comments"><article><p>I disagree</p></article></div><form><p>mail</p></form><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst paragraph goes on.\n\nSecond one\n\nThird\n\na\n\nb"
    plain = "<div class=sidebar><p>links</p></div><div><h1>Head</h1><p>" + "long text " * 20 + "</p></div><ul><li><a href=x>more</a></li></ul><div class='cookie-notice'>We use cookies " + "a lot " * 30 + "</div>"
    assert html_text.main_text(plain) == "Head\n\n" + ("long text " * 20).strip()
    for odd, want in ((None, ""), ("", ""), ("<p>short", "short"), ("a < b & c <b", "a < b & c"), ("<script>x", ""), ("<!-- x", ""), ("<div class=ad>x<article><p>y</article>", "y"), ("<p>" * 3000 + "z", "z")):
        assert html_text.main_text(odd) == want
    rows = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (1, "u", page, 5)], "page_id long, url string, html string, text int")
    got = html_text.extract_pages(rows).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)


def test_line_regions():
    assert html_text.regions([0, 0, 0, 10, 0, 5, 0, 0, 0, 0, 3]) == [(1, 6, 15), (8, 11, 3)] and html_text.regions([]) == []


def chats(spark):
    rows = [
        (1, 0, "user", "Where is the red house?\nIt should be near the river.", 0),
        (1, 1, "assistant", "> Where is the red house?\nBehind the mill, north of the bridge.", 0),
        (1, 2, "user", "Something else entirely now.", 0),
        (1, 3, "assistant", ">> Where is the red house?\n> Behind the mill,  NORTH of the bridge.\nExactly so.\n> never said by anyone here\nok", 0),
        (1, 4, "user", "> Where is the red house?\n> It should be near the river.\nfound it", 0),
        (2, 0, "user", "> Where is the red house?\nquote of another conversation", 0),
        (2, 1, "user", None, 0), (None, 0, "user", "> x", 0), (3, None, "user", "> x", 0), (2, 1, "user", None, 0),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body int")


def test_quotes_link_to_what_was_said(spark):
    got = {(r.conv_id, r.turn): r for r in quote_chat.format_conversations(chats(spark)).collect()}
    view = {k: (r.parent_turn, r.root_turn, r.n_quotes, r.n_linked) for k, r in got.items()}
    assert view[1, 0] == (None, 0, 0, 0) and view[1, 1] == (0, 0, 1, 1) and view[1, 2] == (None, 2, 0, 0)
    assert view[1, 3] == (1, 0, 3, 2) and view[1, 4] == (0, 0, 1, 1)
    assert view[2, 0] == (None, 0, 1, 0) and view[2, 1] == (None, 1, 0, 0) and view[None, 0][0] is None and view[3, None][1] is None
    assert got[1, 1].body == "Behind the mill, north of the bridge." and got[1, 3].body == "Exactly so.\nok" and got[2, 1].body == ""
    assert got[1, 4].chat == "<|user|>\nfound it\n<|end|>\n" and ">" not in got[1, 3].body
    assert quote_chat.format_conversations(chats(spark)).count() == 10 and quote_chat.format_conversations(chats(spark).limit(0)).count() == 0


def test_short_quoted_lines_link_to_the_latest_that_said_them(spark):
    rows = [(1, 1, "user", "The build is green now.\nShip it?"), (1, 2, "user", "> Ship it?\nYes.")]
    rows += [(2, t, "user", "Why?\n" + f"number {t}" if t % 300 == 0 else f"> Why?\nbecause of {t}") for t in range(0, 1000, 50)]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn) for r in quote_chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2] == (1, 1)
    assert all(got[2, t] == ((t // 300 * 300,) * 2 if t % 300 else (None, t)) for t in range(0, 1000, 50))


def test_native_operators_run_no_python(spark, docs):
    for df in (license_scan.scan_licenses(docs), quote_chat.format_conversations(chats(spark)), quote_chat.ordered(quote_chat.format_conversations(chats(spark)))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_licenses_against_brute_force(spark, docs, empty):
    extra = [(1, "x y z Released under the MIT License. and so on", 1), (2, "Licensed under CC\n BY-NC  4.0.", 1), (3, None, 1), (4, "released under", 1)]
    long = license_scan.TEMPLATES["apache-2.0-notice"].split()
    extra.append((5, "a b c d e f g " + " ".join(long[:30] + ["CHANGED"] + long[31:]) + " tail of the text", 1))
    extra.append((6, " ".join(long[: len(long) // 2]), 1))
    got = {(r.doc_id, r.template_id): (round(r.containment, 9), r.start_word) for r in license_scan.scan_licenses(spark.createDataFrame(extra, "doc_id long, text string, h int")).collect()}
    want = {}
    for i, text, _ in extra:
        w = license_scan.template_words(text or "")
        g = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for name, template in license_scan.TEMPLATES.items():
            t = license_scan.template_words(template)
            tg = [tuple(t[j : j + 5]) for j in range(len(t) - 4)]
            hop = max(1, len(tg) // 4)
            best = max(((len(set(g[s : s + len(tg) + hop - 1]) & set(tg)) / len(set(tg)), -s) for s in range(0, len(g), hop)), default=(0, 0))
            if best[0] >= 0.8:
                want[i, name] = (round(best[0], 9), -best[1])
    assert got == want and (5, "apache-2.0-notice") in got and (6, "apache-2.0-notice") not in got
    assert license_scan.scan_licenses(docs).count() == 0 and license_scan.scan_licenses(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, {"x": "too short"})


def test_conv_quality_learns_and_holds_out(spark, empty):
    import random
    import zlib

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        words = [word() for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(words) if good else " ".join(w + rng.choice(["###", "$$$"]) for w in words), 1.0))
        labels.append((i, int(good)))
    rows += [(None, "abc", 1.0), (900, None, 1.0), (901, "", 1.0), (5, rows[5][1], 1.0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = conv_quality.train(docs, marks, sample=80)
    got = conv_quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95
    assert conv_quality.score_documents(empty, model).count() == 0
    none = conv_quality.train(docs, marks.where("quality = 1"))
    assert abs(conv_quality.score_texts(none, pa.array(["a", None]))[0] - 0.99) < 0.02


def test_long_license_texts_are_cut_into_pieces(spark, monkeypatch):
    notice = license_scan.TEMPLATES["gpl-notice"]
    text = " ".join(["word"] * 37 + [license_scan.TEMPLATES["mit-line"]] + ["filler"] * 211 + [notice])
    rows = [(i, " ".join(["lead"] * i + [text] * 3)) for i in range(0, 70, 7)]
    want = None
    for piece in (1 << 20, 2048, 64, 17):
        monkeypatch.setattr(license_scan, "PIECE", piece)
        got = sorted(map(tuple, license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        want = want or got
        assert got == want and len(got) == 2 * len(rows)


def brute_score(model, text):
    """The forward pass, one window at a time."""
    import numpy as np

    c = conv_quality
    raw = (text or "").encode()
    halves = max(2, -(-len(raw) // c.HALF))
    raw += bytes(halves * c.HALF + c.WIDTH - len(raw))
    top = [np.max([sum(model.tables[j][raw[p + j]] for j in range(c.WIDTH)) for p in range(h * c.HALF, (h + 1) * c.HALF, c.STEP)], axis=0) for h in range(halves)]
    logits = [np.maximum(np.maximum(a, b) + model.bias, 0) @ model.out for a, b in zip(top, top[1:])]
    return 1 / (1 + np.exp(-(np.mean(logits) + model.offset + model.log_odds)))


def test_scores_against_a_plain_forward_pass(rows):
    import numpy as np

    rng = np.random.default_rng(1)
    texts = [r[1] for r in rows[:40]] + ["x", None, "", "é" * 700, "ab " * 1000]
    model = conv_quality.fit([t or "" for t in texts], np.arange(len(texts)) % 2, 20, 30)
    model.out = model.out + rng.normal(0, 0.3, model.out.shape).astype(np.float32)
    got = conv_quality.score_texts(model, pa.array(texts, pa.string()))
    assert np.allclose(got, [brute_score(model, t) for t in texts], atol=1e-4) and got.std() > 0.01


def test_training_does_not_depend_on_partitions_or_conflicts(spark):
    rows = [(i % 60, f"text {i} " + ("good words here " if i % 2 else "### $$$ ") * 9) for i in range(120)] + [(70, "long " * 40_000)]
    labels = [(i, i % 2) for i in range(60)] + [(7, 0), (8, 1), (70, 1), (None, 1), (9, None), (10, 5)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    one = conv_quality.train(docs.repartition(1), marks, sample=10)
    many = conv_quality.train(docs.repartition(7, "text"), marks.repartition(5), sample=10)
    assert (one.tables == many.tables).all() and one.log_odds == many.log_odds and one.offset == many.offset


def brute_verdict(text):
    """kept, ratio and bad chunks by the tables of the rules, one call at a time."""
    import zstandard

    raw = (text or "").encode()
    size = lambda b: len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(b)) / len(b)
    if not raw:
        return False, None, 0
    cuts = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
    if len(cuts) > 1 and len(cuts[-1]) < 1024:
        cuts[-2:] = [cuts[-2] + cuts[-1]]
    bad = sum(not 0.45 <= size(c) <= 0.75 for c in cuts) if len(cuts) > 1 else 0
    low, high = next((lo, hi) for below, lo, hi in quality_rules.BANDS if len(raw) < below)
    return not brute_rules(text)[5] and low <= size(raw) <= high and bad <= 0.25 * len(cuts), size(raw), bad


def test_verdicts_against_brute_force(spark, docs, rows):
    import base64
    import random

    rng = random.Random(2)
    noise = [(1, base64.b64encode(rng.randbytes(n)).decode()) for n in (60, 900, 9000)] + [(2, "the same sentence again " * 40), (3, " ".join(str(rng.random()) for _ in range(900)))]
    frame = spark.createDataFrame([*((r[0], r[1]) for r in rows), *noise, *((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())], "doc_id long, text string")
    plain = lambda k, z, n: (bool(k), None if z is None else round(z, 9), n)
    got = sorted(map(str, (plain(r.kept, r.zstd_ratio, r.n_bad_chunks) for r in quality_rules.score_documents(frame).collect())))
    want = [plain(*brute_verdict(r.text)) for r in frame.collect()]
    assert got == sorted(map(str, want)) and 50 < sum(k for k, _, _ in want) < len(want) - 5

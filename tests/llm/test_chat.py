"""Quotation linking against a plain walk over every conversation."""

import random
import re
from collections import defaultdict

from strataflow.llm import quote_chat

DDL = "conv_id long, turn long, role string, text string, body int, depth string"
SPACE = re.compile("[\x20\x09-\x0d]+")
MARK = re.compile(r"^[ \t]*(?:>[ \t]?)+")


def norm(text):
    return SPACE.sub(" ", text).lower().strip(" ")


def units(text):
    parts = [text, *re.split(r"\n[ \t]*\n", text), *text.split("\n")]
    return {norm(x) for x in parts} - {""}


def brute(rows):
    """(conv, turn) -> [(parent, root, depth, order, quotes, linked)] of each message."""
    said, parsed = defaultdict(list), []
    for conv, turn, _, text, *_ in rows:
        lines = []
        for line in (text or "").split("\n"):
            m = MARK.match(line)
            lines.append((m[0].count(">") if m else 0, line[m.end() :] if m else line))
        quoted, last = [], 0
        for level, content in lines:
            if level and level == last:
                quoted[-1][1].append(content)
            elif level:
                quoted.append((level, [content]))
            last = level
        parsed.append((conv, turn, quoted))
        if conv is not None and turn is not None:
            for u in units("\n".join(c if not level else "" for level, c in lines)):
                said[conv, u].append(turn)
    parents, found = defaultdict(list), []
    for conv, turn, quoted in parsed:
        linked, parent = 0, None
        for level, content in quoted if conv is not None and turn is not None else []:
            best = max(((len(u), t) for u in units("\n".join(content)) for t in said[conv, u] if t < turn), default=None)
            if best:
                linked += 1
                parent = best[1] if parent is None and level == 1 else parent
        found.append((conv, turn, parent, len(quoted), linked))
        if parent is not None:
            parents[conv, turn].append(parent)
    kids, top = defaultdict(list), {k: max(v) for k, v in parents.items()}
    for (conv, turn), parent in top.items():
        kids[conv, parent].append(turn)
    place = {}
    for conv, turn in {(c, p) for (c, _), p in top.items()} - set(top):
        stack, n = [(turn, 0)], 0
        while stack:
            at, depth = stack.pop()
            place[conv, at] = (turn, depth, n)
            n += 1
            stack += [(t, depth + 1) for t in sorted(kids[conv, at], reverse=True)]
    return sorted(str((c, t, p, *place.get((c, t), (t, 0, 0)), q, n)) for c, t, p, q, n in found)


def talk(rng, conv, n):
    """Messages that quote whole messages, paragraphs, lines and strangers, at up to three levels."""
    phrases = ["Ship it?", "yes", "The build is GREEN  now.", "no", "see   the log", "ok then", "what about\ttests"]
    rows, texts = [], []
    for turn in range(n):
        parts = []
        for _ in range(rng.randint(0, 2) if texts else 0):
            source = rng.choice(texts).split("\n")
            lo = rng.randrange(len(source))
            mark = rng.choice(["> ", ">", ">> ", " > > "])
            parts += [mark + x for x in source[lo : lo + rng.randint(1, 4)]]
            parts.append(rng.choice(["", "I agree", "> never said"]))
        parts += [rng.choice(phrases) + rng.choice(["", f" {turn}"]) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:
            parts.insert(rng.randrange(len(parts)), "")
        texts.append("\n".join(parts))
        rows.append((conv, turn * rng.choice([1, 1, 3]) if turn else 0, "user", texts[-1], 0, "x"))
    return rows


def view(df):
    return sorted(str((r.conv_id, r.turn, r.parent_turn, r.root_turn, r.depth, r.reply_order, r.n_quotes, r.n_linked)) for r in df.collect())


def test_links_and_order_against_a_plain_walk(spark, monkeypatch):
    rng = random.Random(4)
    rows = [r for conv in range(12) for r in talk(rng, conv, rng.randint(1, 40))]
    rows += [rows[5], rows[30], (None, 1, "user", "> yes", 0, "x"), (3, None, "user", "> yes\nno", 0, "x"), (99, 0, None, None, 0, None), (99, 1, "user", "", 0, None), (99, 1, "user", "", 0, None)]
    rng.shuffle(rows)
    want = brute(rows)
    df = spark.createDataFrame(rows, DDL)
    assert view(quote_chat.format_conversations(df)) == want and sum("None, " not in w for w in want) > 50
    monkeypatch.setattr(quote_chat, "SPAN", 3)
    assert view(quote_chat.format_conversations(df)) == want


def test_a_chain_of_replies_is_ranked_whole(spark):
    rows = [(1, t, "user", (f"> message {t - 1}\n" if t else "") + f"message {t}", 0, "x") for t in range(300)] + [(1, 1000 + t, "user", "> message 0\nnoted", 0, "x") for t in range(300)]
    got = {r.turn: (r.root_turn, r.depth, r.reply_order) for r in quote_chat.format_conversations(spark.createDataFrame(rows, DDL)).collect()}
    assert all(got[t] == (0, t, t) for t in range(300)) and all(got[1000 + t] == (0, 1, 300 + t) for t in range(300))
    ordered = [r.turn for r in quote_chat.ordered(quote_chat.format_conversations(spark.createDataFrame(rows, DDL))).collect()]
    assert ordered == [*range(300), *range(1000, 1300)]

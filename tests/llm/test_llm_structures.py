"""Token counts, word runs and conversation repair against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from llm_helpers import CLASHING, WORD, edge_documents

from orderlens.llm import grammar, queries, repair, runs, token_counts
from orderlens.llm.base import read

SPECIAL = "<|endoftext|>"
ODD_TEXTS = [f"a{SPECIAL}b {SPECIAL}{SPECIAL}", "՘x ՘ y", "    x\u0085 ᠎ y​ z", "it's 'S 'll don't",
             "\U0001d7d8 ½ x́", "꟎" + "a" * 50, "\x1c\x1d a\x1f b", "   ", "\n\n\n a", "a  \t b  ",
             "1234 5678x90", "!!! ??? ...", "\U0001f600 \U0001f600\U0001f600", "word " * 300_000]


# ---- token counts

def test_token_counts_equal_the_library(spark, sf):
    from tokenizers import Tokenizer
    path = queries.counting_tokenizer_path()
    whole = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in read(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n = len(whole.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 512)
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    for r in token_counts.token_counts(rows, path).collect():
        assert r.n_tokens == len(whole.encode(ODD_TEXTS[r.doc_id], add_special_tokens=False).ids), ODD_TEXTS[r.doc_id][:20]


def test_whole_tokens_are_one_token_in_any_text():
    from tokenizers import Tokenizer
    path = queries.counting_tokenizer_path()
    whole, proven = Tokenizer.from_file(path), token_counts.whole_tokens(path)
    assert len(proven) > 49_000
    for piece in proven[::97]:
        assert len(whole.encode(piece, add_special_tokens=False).ids) == 1


def test_token_counts_on_edge_rows(spark):
    docs = edge_documents(spark).withColumnRenamed("size", "n_tokens")
    got = token_counts.token_counts(docs, queries.counting_tokenizer_path(), keep=["doc_id", "n_chars"])
    assert got.columns == ["doc_id", "n_chars", "n_bytes", "n_tokens", "over_limit"] and got.count() == docs.count()
    assert sorted((r.n_bytes, r.n_tokens) for r in got.collect())[:3] == [(0, 0)] * 3
    assert token_counts.token_counts(docs.limit(0), queries.counting_tokenizer_path()).count() == 0


def test_other_tokenizer_kinds_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"), [])


# ---- grammars and runs

def plain_runs(words, least=12):
    """Every period is tried on the whole text."""
    names = {}
    codes, found = np.array([names.setdefault(w, len(names)) for w in words], np.int64), {}
    for q in range(1, len(words) // 2 + 1):
        same = np.concatenate(([0], codes[:-q] == codes[q:], [0])).astype(np.int8)
        begins, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for k in np.flatnonzero(ends - begins >= max(least - q, q)).tolist():
            found.setdefault((int(begins[k]), int(ends[k]) + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def run_row(words):
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    digest = [hashlib.sha256(t.encode()).hexdigest() for t in (
        "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def damaged(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def random_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(0, rng.choice([5, 20, 60, 200])))]
    if rng.random() < 0.5:
        part = words[:rng.randint(1, 8)] or [0]
        words = words + part * rng.randint(1, 9) + words + part * rng.randint(1, 9)
    return words


def test_runs_equal_every_period_tried():
    rng = random.Random(3)
    for _ in range(150):
        docs = [random_words(rng) for _ in range(rng.randint(1, 6))]
        starts = np.cumsum([0, *map(len, docs)])
        seq, s, e, p = runs.maximal_runs(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), list(map(len, docs))))
        for d, words in enumerate(docs):
            mine = seq == d
            assert list(zip((s[mine] - starts[d]).tolist(), (e - s)[mine].tolist(), p[mine].tolist())) == plain_runs(words)


@pytest.mark.parametrize("words, want", [
    ([0] * 100_000, [(0, 100_000, 1)]), (list(range(4000)) * 9, [(0, 36_000, 4000)]), (list(range(11)), []),
    ([0, 1] * 6, [(0, 12, 2)]), ([0, 1] * 5 + [0], [])])
def test_runs_of_stated_words(words, want):
    seq, s, e, p = runs.maximal_runs(np.array(words, np.int64), np.zeros(len(words), np.int64))
    assert list(zip(s.tolist(), (e - s).tolist(), p.tolist())) == want


def test_grammar_gives_its_sequences_back_and_leaves_no_pair_twice():
    rng = random.Random(4)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        codes, owner = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), list(map(len, docs)))
        g = grammar.re_pair(codes, owner)

        def spelled(symbol):
            k = symbol - g.first
            return [symbol] if k < 0 else spelled(g.left[k]) + spelled(g.right[k])
        for d, words in enumerate(docs):
            rest = g.symbols[g.owner == d].tolist()
            assert sum(map(spelled, rest), []) == words
        pairs, i = {}, 0
        while i + 1 < len(g.symbols):  # greedy from the left: no overlap
            if g.owner[i] == g.owner[i + 1]:
                pair = (g.symbols[i], g.symbols[i + 1])
                assert pairs.get(pair, i) > i - 1 or pairs[pair] + 1 == i
                pairs.setdefault(pair, i)
            i += 1


def test_word_runs_query_equals_plain_version(spark, sf):
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_word_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    assert got == {i: run_row(damaged(i, t)) for i, t in texts.items()}
    assert any(g[0] for i, g in got.items() if zlib.crc32(str(i).encode()) % 10 == 0)


def test_word_runs_on_edge_rows(spark):
    docs = edge_documents(spark).withColumnRenamed("size", "period")
    got = runs.run_digests(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *run_row(WORD.findall(t or ""))) for i, t in texts), key=key)
    spans = [tuple(r)[1:] for r in runs.run_spans(docs.filter("doc_id = 10")).collect()]
    assert spans == plain_runs(WORD.findall("a a a a\na a a a\n" * 40))
    assert runs.run_digests(docs.limit(0)).count() == 0
    planted = {r.doc_id: r.text for r in queries.with_periods(docs).filter("doc_id is not null").collect()}
    assert {i: WORD.findall(t or "") for i, t in planted.items()} == {i: damaged(i, t) for i, t in texts if i is not None}


# ---- conversation repair

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def plain_repair(rows):
    """(turn, role, text) in order: the result row by a search over rows and states."""
    seen, faults = set(), []
    for _, role, text in rows:
        visible = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else
                      "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        after = {}

        def offer(state, value):
            if state not in after or value[:2] < after[state][:2]:
                after[state] = value
        for begin, value in best.items():
            state, (cost, edits, out) = begin, value
            for _ in range(4):
                offer(state, (cost + 2, edits + "D", out))
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault else 0
                    to = NEXT[state]
                    offer(to, (cost + 1 + extra, edits + "R", (*out, f"{'user' if to == 2 else 'assistant'}:{text}")))
                    to = KEPT.get((role[:1], state))
                    if to is not None:
                        offer(to, (cost + extra, edits + "K", (*out, f"{role}:{text}")))
                state = NEXT[state]
                cost, edits, out = cost + 5, edits + "I", (*out, "user:" if state == 2 else "assistant:")
        best = after
    ends = []
    for state, (cost, edits, out) in best.items():
        while state not in (0, 3):
            state = NEXT[state]
            cost, edits, out = cost + 5, edits + "I", (*out, "user:" if state == 2 else "assistant:")
        ends.append((cost, edits, out))
    cost, edits, out = min(ends)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else "".join(c for c in text if c not in ".!?") if lot == 2 else text
        kept.extend([(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1))
    return {c: plain_repair(ordered(rows)) for c, rows in out.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_repair_query_equals_plain_search(spark, folder):
    rows = read(spark, f"/root/testdata/{folder}", "conversations")
    want = plain_damage([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, f"/root/testdata/{folder}").collect()}
    assert got == want and sum(g[5] for g in got.values()) > 0


def random_turns(rng, conv, n):
    return [(conv, rng.choice([t, t, None, t // 2]), rng.choice(["system", "user", "assistant", "tool", "", None]),
             rng.choice([None, "", " \n", "Yes.", "No", "Why?", f"Text {t}.", f"Cut {t}"])) for t in range(n)]


def test_repair_of_random_and_edge_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = sum((random_turns(rng, c if c else None, rng.randint(1, 9)) for c in range(120)), [])
    rows += random_turns(rng, 500, 900) + [(500, 3, "user", "Again.")] * 400 + [(501, 0, "user", "x")]
    wide = [(*r, *[str(i) for i in range(len(CLASHING))]) for r in rows]
    table = spark.createDataFrame(wide, "conv_id long, turn long, role string, text string, "
                                  + ", ".join(f"{c} string" for c in CLASHING))
    plain = {}
    for conv, turn, role, text in rows:
        plain.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: plain_repair(ordered(r)) for c, r in plain.items()}
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(table.repartition(7)).collect()} == want
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 16)
    monkeypatch.setattr(repair, "SEGMENT_CHARS", 200)
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(table.repartition(5)).collect()} == want
    empty = repair.repair_conversations(table.limit(0))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(queries.damaged_turns(table), copies_col="copies").collect()}
    assert got == plain_damage(rows)


def test_matrices_equal_plain_search_on_symbols():
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "tool"]
    sequences = [bytes(48 + rng.randrange(9) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    made = repair.Matrices(sequences)
    for at, symbols in enumerate(sequences):
        rows = [(t, "user", "") if s == 48 else (t, roles[(s - 49) // 2], f"{t}" + "." * (s % 2)) for t, s in enumerate(symbols)]
        node = made.root[at]
        ends = [(int(made.cost[node, 0, q]) + 5 * len(repair.CLOSING[q]), made.edits(node, 0, q) + repair.CLOSING[q])
                for q in range(4) if made.cost[node, 0, q] < repair.FAR]
        assert min(ends) == plain_repair(rows)[5:7]

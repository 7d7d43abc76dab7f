import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_helpers import EDGE_ROWS, LONG, WORD, edge_documents
from pyspark.sql import functions as F

from orderlens.llm import hosts, lines, pack, spans
from orderlens.llm.base import mix, n_words, read
from orderlens.llm.queries import op3_line_dedup, op6_pack, op7_span_dedup, op8_host_rules, tokenizer_path

SHAPE = (2, (0, 1), 16)


def test_line_dedup_equals_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    want = repeated_lines_go({r.doc_id: r.text for r in docs.collect()})
    rows = lines.line_dedup(docs).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r.n_removed for r in rows) > 0


def test_chunks_depend_on_their_own_lines_only():
    rng = np.random.default_rng(1)
    body = [f"line {x}" for x in rng.integers(0, 10**6, 200)]

    def found(rows, shape=SHAPE):
        return {("\n".join(rows[a:b + 1]), kind, hashed) for a, b, kind, hashed in lines.chunks_of("\n".join(rows), shape)}
    whole = found(body)
    for skip in (1, 2, 7):
        assert found(["new", *body]) >= whole and found(body[skip:]) <= whole
        assert found(body[:-skip]) <= whole
    texts = {t for t, _, _ in whole}
    assert {"\n".join(body[i:i + 2]) for i in range(199)} <= texts  # all residues: every pair is a chunk
    assert any(t.count("\n") > 3 for t in texts) and all(1 <= t.count("\n") < 16 for t in texts)
    assert len(found(body, (2, (0,), 16))) < 0.7 * len(whole)
    assert len({h for _, _, h in whole}) == len(whole)
    assert lines.chunks_of("", SHAPE) == lines.chunks_of("one line", SHAPE) == lines.chunks_of("\n \n\t", SHAPE) == []


def test_different_bytes_under_one_hash_stay(spark, monkeypatch):
    class Flat:
        @staticmethod
        def xxh3_64_intdigest(text):
            return 7
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c\nd"), (3, "a\nb")], "doc_id long, text string")
    monkeypatch.setattr(lines, "xxhash", Flat)
    got = {r.doc_id: r.text for r in lines.line_dedup(docs).collect()}
    assert got == {1: "a\nb", 2: "c\nd", 3: ""}


def test_line_dedup_of_edge_rows(spark):
    rows = lines.line_dedup(edge_documents(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and by[2].text is None and by[2].n_lines == 0 and by[4].text == EDGE_ROWS[3][1]
    assert by[6].text == LONG and by[10].n_removed > 0 and by[1].hash == "10"
    assert lines.line_dedup(edge_documents(spark).filter("doc_id < 0")).count() == 0


def repeated_lines_go(texts):
    """Lines of any two consecutive lines that an earlier place has too, but for those of the first place."""
    first, out = {}, {}
    for key in sorted(texts):
        lines_, gone = texts[key].split("\n"), set()
        for i, pair in enumerate(zip(lines_, lines_[1:])):
            if "".join(pair).strip(lines.BLANK):
                if pair not in first:
                    first[pair] = (key, i)
                else:
                    gone.update((i + 1,) if first[pair] == (key, i - 1) else (i, i + 1))
        out[key] = "\n".join(x for i, x in enumerate(lines_) if i not in gone)
    return out


def test_every_repeated_pair_of_lines_goes(spark, sf, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    for size in (2, 3, 4, 5):
        for _ in range(10):
            passage = [f"shared {x}" for x in rng.integers(0, 10**9, size)]
            for _ in range(2):
                own = [f"own {x}" for x in rng.integers(0, 10**9, int(rng.integers(2, 9)))]
                at = int(rng.integers(0, len(own) + 1))
                rows.append((10**6 + len(rows), "\n".join([*own[:at], *passage, *own[at:]])))
    rows.append((10**7, "same\nsame\nsame\nsame"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op3_line_dedup(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in got.items()} == repeated_lines_go(dict(rows))
    planted = [got[k] for k, text in rows if 10**6 <= k < 10**7]
    assert all("shared" not in r.text and r.n_removed >= 2 for r in planted[1::2])
    assert all(r.n_removed == 0 for r in planted[::2]) and got[10**7].text == "same\nsame"


ENDS = re.compile(r"[.!?]+[\x20\x09-\x0D]+|\n+")


def plain_units(text, unit):
    """(words of each unit) of one text: sentences, long ones cut behind the smallest pair of each window."""
    out, borders = [], [0, *[m.end() for m in ENDS.finditer(text)], len(text)]
    for low, high in zip(borders, borders[1:]):
        found = WORD.findall(text[low:high])
        if not found:
            continue
        cuts = [0]
        if len(found) > unit:
            window = unit // 2
            h = [xxhash.xxh3_64_intdigest(w.rstrip(".!?")) for w in found]
            pairs = [int(x) for x in mix(np.array(h[:-1], np.uint64), np.array(h[1:], np.uint64))]
            picked = {max(range(j, j + window), key=lambda i: (-pairs[i], i)) for j in range(len(pairs) - window + 1)}
            cuts += sorted(i + 2 for i in picked if i + 2 < len(found))
        out += [found[a:b] for a, b in zip(cuts, [*cuts[1:], len(found)])]
    return out


def unit_key(found):
    return (*found[:-1], found[-1].rstrip(".!?"))


def cut_spans(texts, run=3, least=12, unit=16, grow=True):
    """Units kept of each text; every run is tried."""
    seen, out = set(), {}
    for key in sorted(texts):
        found = plain_units(texts[key], unit)
        sizes, drop = [len(x) for x in found], set()
        for p in range(len(found)):
            for q in range(p + run, len(found) + 1):
                n = sum(sizes[p:q])
                grown = q - p > run
                if grown and (not grow or n - sizes[p] >= least and n - sizes[q - 1] >= least):
                    break
                if n >= least and (not grown or n - sizes[p] < least or n - sizes[q - 1] < least):
                    name = tuple(unit_key(x) for x in found[p:q])
                    if name in seen:
                        drop.update(range(p, q))
                    seen.add(name)
        out[key] = [w for i, x in enumerate(found) if i not in drop for w in x], len(found), len(drop)
    return out


@pytest.mark.parametrize("grow", [True, False])
def test_span_dedup_equals_brute_force(spark, sf, grow):
    docs = read(spark, sf, "documents")
    want = cut_spans({r.doc_id: r.text for r in docs.collect()}, grow=grow)
    rows = spans.span_dedup(docs, grow=grow).collect()
    assert {r.doc_id: (WORD.findall(r.text), r.n_sentences, r.n_removed) for r in rows} == want
    assert sum(r.n_removed for r in rows) > 0


def test_planted_passage_goes_and_clean_text_stays(spark):
    passage = " ".join(f"Word{i} comes here again and again." for i in range(12))
    long_one = " ".join(f"very{i}" for i in range(55)) + "."
    clean = [" ".join(f"Own{d}s{i} sentence number {i} of text {d}." for i in range(20)) for d in range(6)]
    rows = [(0, clean[0] + "\n" + passage), (1, clean[1] + "\n" + passage + "\n" + clean[2]),
            (2, clean[3] + "\n" + long_one), (3, long_one + "\n" + clean[4]), (4, clean[5])]
    got = {r.doc_id: r for r in spans.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[2].text == rows[2][1] and got[4].text == clean[5]
    assert got[1].text == clean[1] + "\n" + clean[2]
    assert got[3].text.endswith(clean[4]) and "very20" not in got[3].text
    taken = got[1].removed[0]
    assert rows[1][1][taken.start:taken.end].strip() == passage


def test_a_repeated_list_of_short_lines_goes(spark, tmp_path):
    items = [f"item{i} no{i}" for i in range(30)]
    uneven = ["one.", "two words.", "now three words.", "a.", "b.", *[f"c{i}." for i in range(11)], "five more words are here."]
    own = [f"Text {d} has its own words in {d + 1} places here." for d in range(6)]
    rows = [(d, "\n".join([own[d], *items, own[d + 3]])) for d in range(3)]
    rows += [(d, " ".join([own[d - 3], *uneven, own[d]])) for d in (3, 4)]
    few = "\n".join(["a b", "c d", "e f", "g h", "i j"])  # 10 words
    rows += [(d, f"Head {d}\n{few}\nTail {d}") for d in (5, 6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op7_span_dedup(spark, str(tmp_path)).collect()}
    assert all(got[d].text == rows[d][1] for d in (0, 3, 5, 6))
    assert got[1].text == own[1] + "\n" + own[4] and got[1].n_removed == 30
    assert got[2].text == own[2] + "\n" + own[5]
    assert got[4].text == own[1] + " " + own[4]


def test_a_passage_behind_other_words_of_its_sentence_goes(spark):
    passage = " ".join(f"inner{i}" for i in range(55))
    own = [" ".join(f"own{d}x{i}" for i in range(n)) for d, n in enumerate((0, 1, 5, 11, 20, 38))]
    rows = [(d, f"{x} {passage} {x[::-1]}.".strip()) for d, x in enumerate(own)]
    got = {r.doc_id: r.text for r in spans.span_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    for d in range(1, 6):
        left = set(got[d].rstrip(".").split())
        assert set(own[d].split()) <= left and set(own[d][::-1].split()) <= left
        assert not any(f"inner{i}" in left for i in range(9, 46))


def cut_places(words, unit=16):
    return spans.units(pa.array([" ".join(words)]), unit).start.tolist()


def test_long_sentences_are_cut_alike_after_any_prefix():
    rng = np.random.default_rng(2)
    for _ in range(200):
        words = [f"w{x}" for x in rng.integers(0, 900, 120)]
        skip = int(rng.integers(1, 60))
        whole, part = cut_places(words), cut_places(words[skip:])
        assert [x for x in whole if x >= skip + 9] == [x + skip for x in part if x >= 9]
        assert all(b - a <= 9 for a, b in zip(whole, [*whole[1:], 120]))


def test_units_of_odd_texts():
    texts = ["", None, " \n ", "a. b! c", "!!! ...", "x\n\ny z.\n\n", "a.b c?d. e", "w " * 40, "\n.\n! a"]
    u = spans.units(pa.array(texts), 16)
    for i, text in enumerate(texts):
        own = plain_units(text or "", 16)
        mine = slice(u.bounds[i], u.bounds[i + 1])
        assert u.size[mine].tolist() == [len(x) for x in own]
    same = spans.units(pa.array(["One two three. Four", "zero\nOne two three\nFour five"]), 16)
    assert same.hash[0] == same.hash[3] and same.hash[1] != same.hash[4]


def test_span_dedup_of_edge_rows(spark):
    rows = spans.span_dedup(edge_documents(spark)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 13 and by[2].text is None and by[2].n_sentences == 0 and by[3].text == ""
    assert by[1].text == "" and by[1].n_removed == 3 and by[1].host == "3"  # the null id is first
    assert spans.span_dedup(edge_documents(spark).filter("doc_id < 0")).count() == 0


def check_packing(rows, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((str(key), piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(want) == sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    return len(places), sum(r.length for r in rows) / 4096


def test_packing_round_trip_and_fill(spark, sf):
    rows = op6_pack(spark, sf).collect()
    used, bound = check_packing(rows, [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()])
    assert used <= 1.05 * bound + 1


def test_packing_edge_rows_over_many_partitions(spark):
    docs = edge_documents(spark)
    rows = pack.pack_documents(docs.repartition(9), tokenizer_path(), fan_in=2, carry=2).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert pack.pack_documents(docs.filter("doc_id < 0"), tokenizer_path()).count() == 0


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins = pack.best_fit(np.array([60, 50, 40, 30, 20]), 100)
    assert sorted(map(sorted, bins)) == [[0, 2], [1, 3, 4]]


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {x for x, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


def test_rules_equal_brute_force(spark, sf):
    rows = op8_host_rules(spark, sf).collect()
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == measures(texts[r.doc_id])
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert r.kept <= (not r.base_failed)


def test_a_host_of_failures_falls_with_its_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short" if i < 95 else good, "bad") for i in range(100)]
    rows += [(1000 + i, good if i % 10 else "short", f"h{i % 20}") for i in range(2000)]
    rows += [(5000, "short", "tiny"), (5001, good, "tiny"), (5002, good, None)]
    got = hosts.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    by = {r.doc_id: r for r in got.collect()}
    assert not by[99].kept and not by[99].base_failed          # its host fails
    assert by[5001].kept and by[5002].kept                     # one failure in two is no evidence
    assert all(by[1000 + i].kept for i in range(2000) if i % 10)


def test_rules_of_edge_rows(spark):
    rows = hosts.host_rules(edge_documents(spark)).collect()
    want = sorted(measures(t) for _, t, *_ in EDGE_ROWS)
    assert want == sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert hosts.host_rules(edge_documents(spark).filter("doc_id < 0")).count() == 0


def test_word_counts_in_the_jvm(spark):
    odd = ["abc \u2028", "abc def\n\u2029", "a\u0085", "\u0085 b \u0085\n", " \u2028 ", "x\r\n", "\n\u2029\n", "a\x1c b\x1f"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string").select("text", n_words(F.col("text")).alias("n"))
    assert {r.text: r.n for r in rows.collect()} == {t: len(WORD.findall(t)) for t in odd}
    got = edge_documents(spark).select("text", n_words(F.col("text")).alias("n_found")).collect()
    assert all(r.n_found == len(WORD.findall(r.text or "")) for r in got)

"""The operators on documents, against brute force on small fixtures with awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import backoff_lm, decontaminate, license_scan, line_dedup, merge_dropout, ngram_join, repeats, token_files
from tracelake.llm import textops as tx
from tracelake.llm.common import stage_path

DOCS = "doc_id bigint, text string, source string, n_words int"


def words_of(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}é"[: r.randrange(2, 6)] + str(r.randrange(9)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Exact and near copies, null and empty texts, repeated rows, a long text, clashing extra columns."""
    base = [" ".join(words_of(80, k)) for k in range(12)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(20 + k, base[k]) for k in range(4)]  # exact copies
    for k in range(6):  # near copies: some links reach others only through them
        w = base[3].split()
        for j in range(k + 1):
            w[5 + 11 * j] = f"edit{k}"
        out.append((40 + k, " ".join(w)))
    passage = " ".join(words_of(70, 99))
    out += [(60 + k, " ".join(words_of(40, 200 + k)) + " " + passage + " " + " ".join(words_of(40, 300 + k))) for k in range(8)]
    out += [(80, None), (81, ""), (82, "  \n\t"), (83, "one two three"), (84, "One TWO three"), (85, "one two three four five"), (86, "x" * 900), (87, "ab " * 500)]
    out += [(88, "\n".join([base[7][:60], base[7][:60], base[7][1:60], "short", "short", base[8][:50] + "Z" + base[8][51:90], base[8][:90]]))]
    out += [(0, base[0])]  # a repeated row
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 0) for i, t in rows], DOCS).repartition(3)


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()


def test_jaccard_components(spark, rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, sa in sets:
        for b, sb in sets:
            if a != b and sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = Counter((i, len(s), find(i)) for i, s in sets)
    assert Counter(map(tuple, ngram_join.jaccard_components(frame(spark, rows)).collect())) == want
    assert len({i for i, _, c in want if c == 3}) > 3


def test_jaccard_blocks_of_large_cells(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    small = {tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    monkeypatch.setattr(ngram_join, "BLOCK", 256)
    assert small == {tuple(r) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_join.jaccard_components(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert backoff_lm.backoff_scores(none).count() == 0
    assert merge_dropout.encode(none).count() == 0
    assert license_scan.scan_licenses(none).count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0


def test_decontaminate_against_brute_force(spark, rows, monkeypatch):
    text = dict(rows)
    items = [(1, " ".join(text[5].split()[3:30])), (2, "ONE two"), (3, None), (4, ""), (5, " ".join(words_of(30, 777))), (6, " ".join(text[60].split()[50:62])), (6, " ".join(text[60].split()[50:62])), (None, "ab ab")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = Counter()
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, it in items:
            iw = split(it)
            if item is None or not iw:
                continue
            for s in range(max(len(iw) - 9, 1)):
                win = iw[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(item)
        want[(i, len(w), len(hit), tuple(sorted(found, key=str)))] += 1
    got = decontaminate.decontaminate(frame(spark, rows), bench).select("doc_id", "n_words", "n_hit", "items").collect()
    assert Counter((a, b, c, tuple(d)) for a, b, c, d in got) == want
    # A filter that lets everything through, and candidates in small slices, give the same.
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 3)
    monkeypatch.setattr(decontaminate, "SLICE", 7)
    got = decontaminate.decontaminate(frame(spark, rows), bench).select("doc_id", "n_words", "n_hit", "items").collect()
    assert Counter((a, b, c, tuple(d)) for a, b, c, d in got) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def deduplicated(rows, edits, min_chars, near_chars):
    lines = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if len(x) >= min_chars]
    near = lambda x, y: x == y or (min(len(x), len(y)) >= near_chars and abs(len(x) - len(y)) <= edits and edits and distance(x, y) <= edits)
    gone = {(i, k) for i, k, x in lines if any((j, m) < (i, k) and near(x, y) for j, m, y in lines)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}, gone


@pytest.mark.parametrize(("edits", "min_chars", "near_chars"), [(0, 1, 1), (1, 1, 1), (1, 20, 1), (1, 1, 20)])
def test_line_dedup_against_brute_force(spark, rows, edits, min_chars, near_chars):
    rows = [r for r in rows if r[0] != 0]
    long = "L" * 40 + "".join(random.Random(3).choices("abcdefg", k=300))
    rows = rows + [(90, long), (91, long[:200] + long[201:]), (92, long[:100] + "#" + long[101:]), (93, long + "!"), (94, "é" * 30 + "\n" + "é" * 29)]
    rows += [(95, "a\nb\nab\n\nabc"), (96, "abcd\nbcd\nxyz\n\nno"), (97, "a"), (98, "cd"), (99, "axyz\nshort")]
    want, gone = deduplicated(rows, edits, min_chars, near_chars)
    got = line_dedup.dedup_lines(frame(spark, rows), max_edits=edits, min_chars=min_chars, near_chars=near_chars)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert gone and got.columns[:4] == ["doc_id", "text", "source", "n_words"]


@pytest.mark.parametrize("edits", [2, 3])
def test_line_dedup_of_more_edits(spark, edits):
    r = random.Random(edits)
    rows = [(i, "\n".join("".join(r.choices("abc", k=r.randrange(0, 9 - edits))) for _ in range(3))) for i in range(40)]
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, rows), max_edits=edits).collect()} == deduplicated(rows, edits, 1, 1)[0]


def by_rows(rows):
    """What line dedup leaves, in order of (doc_id, null first; the texts' hashes, as given; line number), for one edit; copies of a row go together."""
    places = [(i is not None, i or 0, h, k, x, n) for n, (i, t, h) in enumerate(rows) if t is not None for k, x in enumerate(t.split("\n")) if x]
    near = lambda x, y: x == y or abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1
    gone = {(p[5], p[3]) for p in places if any(o[:4] < p[:4] and near(o[4], p[4]) for o in places)}
    texts = [(str(i), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (n, k) not in gone)) for n, (i, t, _) in enumerate(rows)]
    return sorted(texts, key=str)


def test_line_dedup_of_rows_that_share_ids(spark):
    ids = "doc_id bigint, text string"
    left = lambda rows: sorted([(str(r.doc_id), r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, ids).repartition(3)).collect()], key=str)
    for i in (None, 7):
        got = " / ".join(x[1] for x in left([(i, "x line\nunique A"), (i, "y\nx line")]))
        assert "unique A" in got and "y" in got and got.count("x line") == 1
    r = random.Random(11)
    rows = [(r.choice([None, 1, 2, 2, 3]), "\n".join("".join(r.choices("abc", k=r.randrange(0, 6))) for _ in range(4))) for _ in range(60)]
    rows += [rows[0], rows[1], (None, None), (2, None)]
    hashed = [tuple(x) for x in line_dedup.identified(spark.createDataFrame(rows, ids)).select("doc_id", "text", F.struct("t1", "t2")).collect()]
    assert left(rows) == by_rows(hashed)


def test_line_dedup_of_many_lines_and_clashing_names(spark):
    rows = [(1, "same line\n" * 200_000 + "last"), (2, "x\nsame line")]
    docs = frame(spark, rows).withColumn("_gone", F.lit(1)).withColumn("_lines", F.lit(2))
    got = line_dedup.dedup_lines(docs)
    assert {r.doc_id: (r.text, r.n_removed, r["_gone"], r["_lines"]) for r in got.collect()} == {1: ("same line\nlast", 199_999, 1, 2), 2: ("x", 1, 1, 2)}


def test_line_dedup_is_native(spark, rows):
    plan = line_dedup.dedup_lines(frame(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize(("length", "gram"), [(60, 20), (120, 30)])
def test_repeats_against_brute_force(spark, rows, length, gram):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    want = Counter()
    for i, t in texts:
        cover = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        want[(i, len(t), bytes(b for b, c in zip(t, cover, strict=True) if not c))] += 1
    got = repeats.remove_repeats(frame(spark, rows), length, gram).select("doc_id", "n_bytes", "kept").collect()
    assert Counter((a, b, bytes(c)) for a, b, c in got) == want


def scores(docs, corpus=None, alpha=0.4):
    """Under the counts of a corpus, or for each row of all other rows."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    rows = [split(t) for _, t in (docs if corpus is None else corpus)]
    all_one, all_two = (Counter(x for w in rows for x in part(w)) for part in (lambda w: w, lambda w: zip(w, w[1:], strict=False)))
    out = []
    for i, t in docs:
        w, s, off = split(t), 0.0, 0
        own = corpus is None
        one, two = Counter(w if own else []), Counter(zip(w, w[1:], strict=False) if own else [])
        n = max(all_one.total() - one.total(), 1)
        for k, x in enumerate(w):
            both = (w[k - 1], x)
            if k and all_two[both] > two[both]:
                s += math.log((all_two[both] - two[both]) / (all_one[w[k - 1]] - one[w[k - 1]]))
            else:
                off += k > 0
                s += math.log(max(all_one[x] - one[x], 1) / n) + (math.log(alpha) if k else 0)
        out.append((i, len(w), off, round(s, 6)))
    return Counter(out)


def scored(df):
    return Counter((a, b, c, round(d, 6)) for a, b, c, d in df.collect())


@pytest.mark.parametrize("hot", [4, 1 << 16])
def test_backoff_scores(spark, rows, hot):
    want = scores(rows)
    assert scored(backoff_lm.backoff_scores(frame(spark, rows), hot=hot)) == want
    assert 0 < sum(r[2] for r in want.elements()) < sum(max(r[1] - 1, 0) for r in want.elements())
    corpus, held_out = rows[:20], rows[15:]
    assert scored(backoff_lm.backoff_scores(frame(spark, held_out), frame(spark, corpus), hot=hot)) == scores(held_out, corpus)


def test_backoff_small_runs_and_groups(spark, rows, monkeypatch):
    monkeypatch.setattr(backoff_lm, "GROUP", 50)
    assert scored(backoff_lm.backoff_scores(frame(spark, rows), hot=2)) == scores(rows)


def test_token_counts(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_files.TOKENIZER)
    some = rows + [(None, "no id"), (-5, "negative id")]
    want = Counter((i, len(sp.encode(t or ""))) for i, t in some)
    path = stage_path(spark, "tokens")
    token_files.write_token_files(frame(spark, some), path)
    for block in (1 << 20, 7, 64):  # boundaries everywhere
        got = token_files.count_tokens(spark, path, trailer=token_files.TRAILER, block_tokens=block)
        assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want


def test_token_files_of_others(spark, tmp_path, monkeypatch):
    """Files without markers, an open tail, runs of separators, and blocks in many runs."""
    monkeypatch.setattr(token_files, "RUN", 2)
    (tmp_path / "part-0").write_bytes(np.array([9, 9, 2, 2, 9, 9, 9, 9, 9, 9, 9, 9, 9, 2, 9], "<u2").tobytes())
    (tmp_path / "part-1").write_bytes(b"")
    got = token_files.count_tokens(spark, f"file://{tmp_path}", block_tokens=3).orderBy("start").select("start", "n_tokens", "ended").collect()
    assert [tuple(r) for r in got] == [(0, 2, True), (3, 0, True), (4, 9, True), (14, 1, False)]


def test_merge_dropout(spark, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.TOKENIZER)
    plain = {r.doc_id: r for r in merge_dropout.encode(frame(spark, rows), dropout=0.0).collect()}
    for i, t in rows:
        ids = None if t is None else np.frombuffer(plain[i].ids, "<i4").tolist()
        assert ids == (None if t is None else sp.encode(t)) and plain[i].lossless
    odd = rows + [(300, "▁ literal ▁mark"), (301, "日本 \U0001f600 \x00 tab\t"), (302, " lead  and trail  ")]
    varied = merge_dropout.encode(frame(spark, odd), dropout=0.3, seed=5)
    assert {r.doc_id: r.text for r in merge_dropout.decode(varied).collect()} == dict(odd)
    again = {r.doc_id: bytes(r.ids or b"") for r in merge_dropout.encode(frame(spark, odd).repartition(2), dropout=0.3, seed=5).collect()}
    first = {r.doc_id: bytes(r.ids or b"") for r in varied.collect()}
    other = {r.doc_id: bytes(r.ids or b"") for r in merge_dropout.encode(frame(spark, odd), dropout=0.3, seed=6).collect()}
    assert first == again and sum(first[k] != other[k] for k in first) > len(first) / 2
    assert varied.where("not lossless").count() == 0


def test_merge_dropout_agenda_equals_rounds(monkeypatch):
    m = merge_dropout.model_of(merge_dropout.TOKENIZER)
    texts = [" ".join(words_of(30, k)).encode() for k in range(5)]
    rounds = merge_dropout.encode_chunk(m, texts, np.arange(5), 3, 0.2)
    monkeypatch.setattr(merge_dropout, "LONG", 0)
    agenda = merge_dropout.encode_chunk(m, texts, np.arange(5), 3, 0.2)
    assert (rounds[0] == agenda[0]).all() and (rounds[1] == agenda[1]).all()


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, best[j + 1] = best[j + 1], max(best[j + 1], best[j], old + (x == y))
    return best[-1]


def test_license_scan(spark, rows):
    mit = license_scan.TEMPLATES["mit"]
    w = mit.split()
    changed = " ".join(w[:20] + ["really", "now"] + w[20:40] + w[43:])
    some = rows + [(400, "intro words here " + mit + " tail"), (401, "x " + changed), (402, "Released under the MIT License."), (403, " ".join(w[:30]))]
    got = license_scan.scan_licenses(frame(spark, some)).collect()
    by = {(r.doc_id, r.template): r for r in got}
    assert by[(400, "mit")].coverage == 1.0 and by[(400, "mit")].first_word == 3 and (402, "mit-line") in by and (403, "mit") not in by
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    r = by[(401, "mit")]
    assert r.matched == lcs(split(mit), split(changed)) and r.coverage < 1
    assert {i for i, _ in by} == {400, 401, 402}
    assert license_scan.scan_licenses(frame(spark, rows)).count() == 0


def test_words_and_hashes():
    w = tx.Words([b"Ab c", b"", b" ab  C "], tx.NOT_SPACE)
    assert w.offset.tolist() == [0, 2, 2, 4] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and w.word(0) == b"ab"
    assert tx.gram_hash(w.hash, 9).size == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")

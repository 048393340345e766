"""Each occurrence of a word is segmented by itself."""

import numpy as np

from tracelake.llm import merge_dropout

from .test_text_operators import frame


def segmentations(ids, m):
    """The pieces of each word of a text."""
    text, out = [bytes(m.bytes[m.offset[i] : m.offset[i] + m.length[i]]) for i in ids], []
    for p in text:
        if p.startswith(b" "):
            out.append([])
        out[-1].append(p)
    return [tuple(x) for x in out]


def test_one_word_in_one_document(spark):
    m = merge_dropout.model_of(merge_dropout.TOKENIZER)
    docs = [(1, " ".join(["international"] * 400)), (2, " ".join(["international"] * 400))]
    got = {r.doc_id: segmentations(np.frombuffer(r.ids, "<i4"), m) for r in merge_dropout.encode(frame(spark, docs), dropout=0.3).collect()}
    assert len(got[1]) == 400 and all(b"".join(x) == b" international" for x in got[1])
    assert len(set(got[1])) > 20 and got[1] != got[2]


def test_shared_results_equal_single_ones(monkeypatch):
    m = merge_dropout.model_of(merge_dropout.TOKENIZER)
    texts = [" ".join(["the international situation été  of\tthe \u2581 of"] * 40).encode()] * 3
    for dropout in (0.0, 0.1, 0.6):
        shared = merge_dropout.encode_chunk(m, texts, np.arange(3) - 1, 3, dropout)
        with monkeypatch.context() as c:
            c.setattr(merge_dropout, "alike", lambda m, prefix, start, end, text, key, dropout: key)
            single = merge_dropout.encode_chunk(m, texts, np.arange(3) - 1, 3, dropout)
        assert (shared[0] == single[0]).all() and (shared[1] == single[1]).all()


def naive(m, sp, text, key, seed, dropout):
    """Pieces of a text by repeated search for the best candidate that is not skipped, one unit at a time."""
    mix = merge_dropout.tx.mix
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    ids = {p: sp.piece_to_id(p) for p in score}
    whole = " " + text
    starts = [i for i, c in enumerate(whole) if i == 0 or (c == " " and whole[i - 1] != " ")]
    out = []
    for a, b in zip(starts, [*starts[1:], len(whole)], strict=True):
        raw = np.frombuffer(whole[a:b].encode("utf-32-le"), np.uint32)
        h = merge_dropout.tx.range_hash(merge_dropout.tx.prefix_hash(raw), np.array([0]), np.array([len(raw)]))
        k = mix(np.array([key + seed * 0x9E3779B97F4A7C15 & (2**64 - 1)], np.uint64))
        k = mix(mix(k + np.array([a], np.uint64) * np.uint64(0xA24BAED4963EE407)) + h)
        parts = [(i, c.replace(" ", "▁")) for i, c in enumerate(whole[a:b])]
        while True:
            best = None
            for n, ((i, x), (_, y)) in enumerate(zip(parts, parts[1:], strict=False)):
                if x + y in score and not merge_dropout.skipped(k, np.array([i]), np.array([len(x + y)]), dropout)[0]:
                    best = max(best, (score[x + y], -n)) if best else (score[x + y], -n)
            if best is None:
                break
            n = -best[1]
            parts[n : n + 2] = [(parts[n][0], parts[n][1] + parts[n + 1][1])]
        for _, p in parts:
            out += [ids[p]] if p in ids else [int(m.byte[x]) for x in p.encode()]
    return out


def test_against_a_naive_encoder():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.TOKENIZER)
    m = merge_dropout.model_of(merge_dropout.TOKENIZER)
    texts = ["the international situation  of été and 日本", "internationalization " * 3 + "x" * 80, "a", "lossless decoding, of the   words"]
    for dropout in (0.0, 0.2, 0.5):
        ids, counts = merge_dropout.encode_chunk(m, [t.encode() for t in texts], np.arange(4), 3, dropout)
        ends = np.cumsum(counts)
        for d, t in enumerate(texts):
            assert ids[ends[d] - counts[d] : ends[d]].tolist() == naive(m, sp, t, d, 3, dropout), (t, dropout)

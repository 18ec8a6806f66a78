"""op11 against tokens laid side by side in plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import alignment, queries

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "x ", "\n", "x\n\n y", "a▁b c", "a\x00b", "<s> <|endoftext|> </s>", "tab\there  two", "日本語 テキスト　x", "é é ﬁ", "a" * 3000, "= " * 40,
    "​q   z", "🙂 🙃👍🏽", " \r\n x.\r\n", "x" * 300 + " y's don't", "the the of of", "the the of of", "end \n", "x “ y” z", "a ", "\na\nb", "a\n",
]


def spans(ids, sizes):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(sizes[i]), i))
        at += len(sizes[i])
    return out


def plain(rows):
    """NUMBERS and groups by place of the row, from whole texts."""
    pair, links_of, out, counts = alignment.TokenizerPair(A, B), {}, {}, Counter()
    for k, (_, text) in enumerate(rows):
        if not text:
            continue
        a, b, want = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text), (" " + text).encode()
        if b"".join(pair.a_bytes[i] for i in a) != want or b"".join(pair.b_bytes[i] for i in b) != want:
            continue
        sa, sb = spans(a, pair.a_bytes), spans(b, pair.b_bytes)
        links = [(x, y) for s, e, x in sa for t, f, y in sb if s < f and t < e] if len(sa) < 2000 else None
        assert links is not None
        cuts = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        groups = [",".join(str(i) for _, e, i in sa if low < e <= cut) + "|" + ",".join(str(i) for _, e, i in sb if low < e <= cut) for low, cut in zip([0, *cuts], cuts)]
        links_of[k] = links
        counts.update(links)
        out[k] = [len(a), len(b), len(groups), len(links), ";".join(groups)]
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for k, links in links_of.items():
        out[k][4:4] = [sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)]
    return [tuple(out.get(k, [0] * 6 + [None])) for k in range(len(rows))]


@pytest.mark.parametrize("heavy", [0, 60, 100_000])
def test_equals_tokens_side_by_side(spark, sf_dir, heavy):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars < 1500").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1 - k if k != 3 else None, t) for k, t in enumerate(ODD)]
    made = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, segment string")
    got = alignment.align_documents(made, A, B, heavy)
    have = sorted([tuple(r[c] for c in ("doc_id", *alignment.NUMBERS, "groups")) for r in got.collect()], key=repr)
    assert have == sorted([(i, *x) for (i, _), x in zip(rows, plain(rows))], key=repr)


def test_cuts_do_not_change_tokens():
    pair = alignment.TokenizerPair(A, B)
    assert pair.cuts
    for text in filter(None, ODD):
        cut = pair.segments(text)
        if cut:
            assert "".join(map(pair.whole, cut)) == " " + text
            found = list(pair.encode(cut))
            assert [i for a, _ in found for i in a] == pair.a.encode(" " + text, add_special_tokens=False).ids
            assert [i for _, b in found for i in b] == pair.b.encode(text)
    whole = alignment.TokenizerPair(A, B)
    whole.cuts = False
    assert list(whole.encode([" a▁b", " ab c"]))[0] == ([], []) and list(whole.encode([" ab c"]))[0][1] == pair.b.encode("ab c")


def test_query_digests_groups(spark, tmp_path):
    spark.createDataFrame([(1, "the of"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, str(tmp_path)).collect()}
    assert got[2].groups_sha256 == got[3].groups_sha256 == "" and got[2].n_a == 0
    pair = alignment.TokenizerPair(A, B)
    (a1, b1), (a2, b2) = pair.encode([" the", " of"])
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in ((a1, b1), (a2, b2)))
    assert got[1].groups_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[1].count_sum == 2 and got[1].n_best == 2


def test_no_rows_and_heavy_bound(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(empty, A, B).collect() == []
    results = spark.createDataFrame([(str(i), 1 << (i % 5)) for i in range(50)], "segment string, n long")
    for most in (0, 9, 10, 35, 50):
        kept = alignment.heaviest(results, "n", most).collect()
        assert len(kept) <= most and len(kept) > most - 10


def test_what_travels_to_a_worker_is_small():
    """The results that travel stand once in each worker of an executor, beside the JVM."""
    n = alignment.HEAVY
    rows = pa.table({"segment": [f"word{i:06}" for i in range(n)], **{c: np.arange(n) for c in alignment.NUMBERS}, "groups": ["1234,567|12345"] * n})
    assert alignment.Laid(rows).rows.nbytes < 30e6

"""Repeated passages with fewer than three whole sentences."""

import re

from lexaudit.llm import queries, substring_dedup

WORDS = " ".join(f"word{i}" for i in range(24))
PASSAGE = f"a start within a sentence {WORDS} ends. Two words. And {WORDS} once more. {WORDS} has no end"


def brute_parts(text):
    parts, held = [], ""
    cuts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n\s*", text)), len(text)]
    for a, b in zip(cuts, cuts[1:]):
        held += text[a:b]
        if len(held.split()) >= 2 and b < len(text):
            parts.append(held)
            held = ""
    return parts + [held] * (held != "")


def brute_left(rows):
    """Sentences covered by a repeat of three, or of fewer with twenty words, and the text without them."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        parts, gone = brute_parts(text or ""), set()
        words = [p.split() for p in parts]
        for n in (1, 2, 3):
            for i in range(len(parts) - n + 1):
                if n == 3 or sum(map(len, words[i : i + n])) >= 20:
                    key = tuple(map(tuple, words[i : i + n]))
                    if key in seen:
                        gone |= set(range(i, i + n))
                    seen.add(key)
        out[doc] = (len(gone), text if text is None else "".join(p for i, p in enumerate(parts) if i not in gone))
    return out


def test_a_passage_of_two_whole_sentences(spark):
    rows = [(1, f"First text, {PASSAGE}. End of one."), (2, f"Another text: {PASSAGE} here. It ends."), (3, f"{WORDS}."), (4, f"{WORDS}."), (5, "Two short. Ones here."), (6, "Two short. Ones here."), (7, None), (8, ""), (9, f"{WORDS}.\n{WORDS}.")]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {d: (r["n_repeated"], r["text_left"]) for d, r in got.items()} == brute_left(rows)
    assert (got[2]["n_removed"], got[2]["n_repeated"], got[2]["text_left"]) == (0, 2, f"Another text: a start within a sentence {WORDS} ends. {WORDS} has no end here. It ends.")
    assert [got[d]["n_repeated"] for d in (1, 3, 4, 6, 9)] == [0, 0, 1, 0, 2]
    assert substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_query_against_brute_force_and_long_items(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op7_substring_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_repeated"], r["text_left"]) for r in got} == brute_left(rows)
    assert all(r["n_repeated"] >= r["n_removed"] for r in got) and any(r["n_repeated"] and not r["n_removed"] for r in got)

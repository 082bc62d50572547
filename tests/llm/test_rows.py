import html
import re

import pytest
from pyspark.sql import functions as F

from lexaudit.llm import decontaminate, queries, substring_dedup, url_filter

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_contamination(docs, items, size=10):
    found = {}
    for item, text in items:
        w = WORD.findall(ascii_lower(text or ""))
        if item is not None and w:
            n = min(len(w), size)
            for i in range(len(w) - n + 1):
                found.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, own = WORD.findall(ascii_lower(text or "")), set(), set()
        for n in {len(x) for x in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit |= set(range(i, i + n))
                    own |= found[tuple(w[i : i + n])]
        out[doc] = (len(w), len(hit), len(own), ",".join(sorted(map(str, own))))
    return out


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "short item"),
    (3, "École ÉTÉ naïve \U0001f600 x"),
    (4, None),
    (5, "... !"),
    (6, "the the the the the the the the the the the"),
    (10, "short item"),
    (None, "null id words"),
]
DOCS = [
    (1, "zero ONE two, three four five six seven eight nine ten! eleven twelve thirteen"),
    (2, "a short item and a Short-ITEM"),
    (3, "École ÉTÉ naïve \U0001f600 x; école été naïve \U0001f600 x"),
    (4, None),
    (5, ""),
    (6, "the " * 30_000),
    (7, "clean words only"),
    (8, "one two three four five six seven eight nine"),
    (8, "one two three four five six seven eight nine"),
    (9, "two three four five six seven eight nine ten eleven"),
    (11, "null id words"),
]


def test_contamination_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in DOCS], "doc_id long, text string, phrase string, n int")
    items = spark.createDataFrame([(d, t, 1) for d, t in ITEMS], "item_id long, text string, doc_id int")
    rows = decontaminate.contamination(docs, items).withColumn("sha", F.col("items_sha256")).collect()
    want = brute_contamination(DOCS, ITEMS)
    assert len(rows) == len(DOCS)
    import hashlib

    for r in rows:
        n, hit, k, names = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, k, hashlib.sha256(names.encode()).hexdigest(), hit > 0)
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    assert not decontaminate.contamination(docs, items.limit(0)).where("contaminated").count()
    lone = spark.createDataFrame([(None, "a short item"), (None, "clean"), (7, "no hit"), (7, "one short item")], "doc_id long, text string")
    assert sorted((r["n_words"], r["n_hit"]) for r in decontaminate.contamination(lone, items).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]


def brute_matches(rows, phrases, slop):
    found = set()
    for text in rows:
        w = WORD.findall(ascii_lower(text or ""))
        for p in phrases:
            q = p.split(" ")
            for s in range(len(w)):
                if w[s] == q[0] and all(x in w[max(0, s + j - slop) : s + j + slop + 1] for j, x in enumerate(q) if j):
                    found.add((text, s, p, w[s : s + len(q)] == q))
    return found


@pytest.mark.parametrize("slop", [0, 1, 2, 3])
def test_exact_and_proximity_matches(spark, slop):
    import random

    rng = random.Random(slop)
    rows = ["alpha beta gamma", "alpha x beta gamma", "alpha x y z beta gamma", "gamma alpha beta", "ALPHA beta alpha beta gamma", None, ""]
    rows += [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon", "x"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    phrases = ["alpha beta gamma", "alpha alpha beta", "delta", "gamma delta epsilon alpha x", "unknown alpha"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate([*rows, rows[0]])], "doc_id long, text string, pos int, term string").repartition(3)
    given = spark.createDataFrame([(p, len(p.split())) for p in phrases], "phrase string, n int")
    keys = {r["k"]: r["text"] for r in docs.select(decontaminate.text_key(F.col("text")).alias("k"), "text").collect()}
    want = brute_matches(rows, phrases, slop)
    for index in (None, decontaminate.build_index(docs)):
        got = [(keys[r["text_key"]], r["start"], r["phrase"], r["exact"]) for r in decontaminate.phrase_matches(docs, given, slop, index).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert any(not m[3] for m in want) == (slop > 0)


def brute_sentences(text):
    """Pieces between cuts; one of a single word goes with the next."""
    parts, held = [], ""
    cuts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?])\s+|\n\s*", text)), len(text)]
    for a, b in zip(cuts, cuts[1:]):
        held += text[a:b]
        if len(held.split()) >= 2 and b < len(text):
            parts.append(held)
            held = ""
    return parts + [held] * (held != "")


def brute_dedup(rows, run=3):
    firsts, gone, out = {}, {}, {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        parts = out[doc] = brute_sentences(text or "")
        for i in range(len(parts) - run + 1):
            firsts.setdefault(tuple(" ".join(p.split()) for p in parts[i : i + run]), []).append((doc, i))
    for found in firsts.values():
        for doc, i in sorted(found)[1:]:
            gone.setdefault(doc, set()).update(range(i, i + run))
    for doc, text in rows:
        drop, parts = gone.get(doc, set()), out[doc]
        out[doc] = (len(parts), len(drop), None if text is None else "".join(p for i, p in enumerate(parts) if i not in drop))
    return out


PASSAGE = "One sentence stands here with seven words. Another one follows it with even more words inside. And a third ends the passage now."
REPEATS = [
    (1, f"Start of one. {PASSAGE} End of one."),
    (2, f"Begin of the second text\n\n{PASSAGE}\nEnd of two."),
    (3, f"cut in the middle {PASSAGE} {PASSAGE}"),
    (4, None),
    (5, ""),
    (6, "Too short. To be. A span it is."),
    (7, "Too short. To be. A span it is."),
    (8, " " * 200_000 + "x. " * 300),
    (9, f"Start of one. {PASSAGE} End of one."),
    (10, "\U0001f600 " * 30 + ". é? " * 30),
    (11, "Two sentences only. Of a passage."),
    (12, "Two sentences only. Of a passage."),
    (13, "\n\n a b.\n"),
    (14, "Word. a b. c d. e f. Other"),
    (15, "z y. Word. a b. c d. e f. Other"),
]


def test_substring_dedup_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in REPEATS] + [(None, PASSAGE, 1, "x")], "doc_id long, text string, place int, gone string").repartition(3)
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in substring_dedup.deduplicate(docs).collect()}
    assert got.pop(None) == (3, 0, PASSAGE)
    assert got == brute_dedup(REPEATS)
    assert got[9][2] == "" and got[1][1] == 0 and "Another one follows" not in got[2][2]
    assert got[7][1] == 3 and got[12][1] == 0 and got[15] == (5, 4, "z y. ")
    assert substring_dedup.deduplicate(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "x. " * 100_000), (2, " " * 1_000_000)], "doc_id long, text string")
    assert [r["n_sentences"] for r in substring_dedup.deduplicate(long).orderBy("doc_id").collect()] == [50_000, 1]


def test_substring_dedup_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in queries.op7_substring_dedup(spark, sf).collect()}
    assert got == brute_dedup(rows)


URLS = [
    ("http://A.example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("https://example.net", "example.net", "", None, None),
    ("https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    ("https://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
    ("x://b.org/fr/#a://c", "b.org", "/fr/", "org/fr/", "allow"),
    ("x://b.org?/fr/", "b.org", "", None, None),
    ("no scheme.net/en/", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("://", "", "", None, None),
    ("a://É.NET/\nline", "É.net", "/\nline", "net/", "block"),
    ("a://" + "n" * 100_000 + ".net/" + "p" * 100_000, "n" * 100_000 + ".net", "/" + "p" * 100_000, "net/", "block"),
]


def test_url_rules(spark):
    model = url_filter.fit(url_filter.labelled_urls())
    pages = spark.createDataFrame([(i, u[0], "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, queries.OP8_RULES, model).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == (verdict or ("block" if rows[i]["score"] >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0), queries.OP8_RULES, model).count() == 0
    assert url_filter.judge(pages, (), model).where("rule is not null").count() == 0


def test_url_model_learns_its_table_and_beyond():
    table = url_filter.labelled_urls()
    model = url_filter.fit(table)
    assert all((model.probability(h, p) >= 0.5) == bool(label) for h, p, label in table)
    assert model.probability("m.spam-farm.example.net", "/buy-cheap-pills/9") > 0.5 > model.probability("www.gardennews.example.net", "/en/77")


def test_url_query_rules_in_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = queries.op8_url_filter(spark, sf).toPandas()
    sql = f"""
    SELECT page_id, host, path, rule FROM (
      SELECT page_id, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM '{sf}/pages.parquet'
    ), LATERAL (SELECT max_by(r, length(r)) AS rule FROM (VALUES ('net', '/', 'net/'), ('example.net', '/en/', 'example.net/en/'), ('example.com', '/de/', 'example.com/de/'), ('org', '/fr/', 'org/fr/')) t(h, p, r)
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))"""
    want = duckdb.sql(sql).df().sort_values("page_id")
    have = got.sort_values("page_id")
    for c in ("page_id", "host", "path"):
        assert have[c].tolist() == want[c].tolist()
    assert have["rule"].fillna("").tolist() == want["rule"].fillna("").tolist()


def test_warc_query_keeps_every_visible_word(spark):
    sf = "/root/testdata/sf0.001"
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = [r for r in queries.op1_warc_derivatives(spark, sf).collect() if r["record_type"] == "conversion"]
    assert len(rows) == len(source)
    for r in rows:
        page = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", " ", source[r["page_id"]])
        want = html.unescape(re.sub(r"</?(b|a|i|em|strong|span)\b[^>]*>", "", page))
        assert r["block"].split() == re.sub(r"<[^>]+>", " ", want).split()


@pytest.mark.parametrize("name", ["op1_warc_derivatives", "op8_url_filter"])
def test_page_queries_return_every_page(spark, name):
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert queries.queries()[name](spark, sf).select("page_id").distinct().count() == n

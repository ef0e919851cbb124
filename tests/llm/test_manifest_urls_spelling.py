"""URL classes, Merkle manifest and spelling variants against plain Python, and at the edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rackpulse.llm import link_components, merkle, spelling, url_filters
from rackpulse.llm.queries import URL_RULES
from rackpulse.session import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string, path string, id string, verdict string"


def canonical(url):
    return f'<html><head><link href="{url}" rel="canonical"></head></html>'


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(URL_RULES, "host string, path string, verdict string")


def judged(spark, rules, rows, **more):
    pages = spark.createDataFrame([(i, u, h, "clash", "clash", "clash") for i, u, h in rows], PAGES)
    return {r.page_id: r for r in url_filters.judge_urls(pages, rules, **more).collect()}


def test_longest_rule_decides(spark, rules):
    urls = {
        1: ("https://WWW.Example.com/en/a", "www.example.com/en/", "allow"), 2: ("http://m.example.com/en/?x#y", "example.com/en/", "block"),
        3: ("https://example.com/de/", "com/", "allow"), 4: ("ftp://a.net/es/x?q=/fr/", "net/es/", "block"), 5: ("https://net/fr/", "net/fr/", "block"),
        6: ("https://a.com", None, "allow"), 7: ("a.com/en/", None, "allow"), 8: (None, None, "allow"), 9: ("", None, "allow"), 10: ("https://xnet/es/", None, "allow"),
        11: ("https://" + "a." * 5000 + "net/es/" + "p" * 50_000, "net/es/", "block"), 12: ("https://e.org/?u=http://b.net/es/", None, "allow"),
    }
    got = judged(spark, rules, [(i, u, None) for i, (u, _, _) in urls.items()])
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {i: v[1:] for i, v in urls.items()}
    assert (got[2].host, got[2].path, got[6].path, got[7].host) == ("m.example.com", "/en/", "", "")


def test_blocks_reach_aliases_unless_one_is_allowed(spark, rules):
    rows = [
        # A chain over a page that is not in the table, and one without a rule.
        (1, "https://a.org/1", canonical("https://b.org/2")), (2, "https://c.org/3", canonical("https://b.org/2")), (3, "https://c.org/3", None),
        (4, "https://bad.net/es/x", canonical("//c.org/3")),
        # The same with an allowed member.
        (5, "https://d.org/1", canonical("https://bad.net/fr/1")), (6, "https://good.com/x", canonical("https://d.org/1")), (7, "https://bad.net/fr/1", ""),
        # Only in comments and scripts, or not a canonical link.
        (8, "https://e.org/", "<!--" + canonical("https://bad.net/es/x") + "--><script>" + canonical("https://bad.net/es/x") + "</script>"),
        (9, "https://f.org/", '<link rel="icon" href="https://bad.net/es/x">'),
        # A refresh, a convention, a crawler's redirect.
        (10, "https://g.org/a/b", "<META HTTP-EQUIV='Refresh' CONTENT='0; URL=https://bad.net/es/x'>"), (11, "http://www.g.org/a/b?utm_source=z#top", None),
        (12, "https://h.org/", None), (13, "https://i.org/k/l", canonical("m")), (14, "https://i.org/k/m", None),
    ]
    redirects = spark.createDataFrame([("https://h.org/", "https://i.org/k/l"), ("https://i.org/k/m", "https://bad.net/es/x"), (None, "x")], "src string, dst string")
    got = judged(spark, rules, rows, redirects=redirects)
    blocked = {i for i, r in got.items() if r.verdict == "block"}
    assert blocked == {1, 2, 3, 4, 7, 10, 11, 12, 13, 14} and len(got) == 14
    assert got[7].rule == "net/fr/" and got[1].rule is None


def test_no_pages_and_no_rules(spark, rules):
    empty = spark.createDataFrame([], PAGES)
    assert url_filters.judge_urls(empty, rules).count() == 0
    pages = spark.createDataFrame([(1, "https://a.net/es/", None, None, None, None)], PAGES)
    assert url_filters.judge_urls(pages, rules.limit(0)).first().verdict == "allow"


def test_components_equal_union_find(spark):
    dice = random.Random(5)
    links = [(dice.randrange(400), dice.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 6000 + i) for i in range(300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = link_components.link_components(spark.createDataFrame([*links, (None, 3), links[0]], "a long, b long").filter("a is not null"))
    assert {r.node: r.component for r in got.collect()} == want
    assert link_components.link_components(spark.createDataFrame([], "a long, b long")).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """The contract read aloud: (doc_id, leaf, subroot, root, proof, folded, verified) per row."""

    def leaf(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        changed = n + 1 if hit and n is not None else n
        groups[lang].append((doc_id, leaf((doc_id, source, lang, n, text)), leaf((doc_id, source, lang, changed, text))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for lang in order:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(climb([r[1] for r in groups[lang]]))
    top = climb([t[-1][0] for t in trees])
    out = []
    for g, lang in enumerate(order):
        for i, (doc_id, own, folded) in enumerate(groups[lang]):
            proof, start = "", folded
            for at, levels in ((i, trees[g]), (g, top)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else None
                    folded = sha(folded) if other is None else sha(other + folded) if at % 2 else sha(folded + other)
                    proof += other or ""
                    at //= 2
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
            assert folded != top[-1][0] or start == own
    return out


def manifest_of(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", b"clash") for r in rows], DOCS + ", leaf string, path binary")
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return [tuple(r) for r in merkle.manifest(docs, {"n_chars": F.when(hit, more).otherwise(F.col("n_chars").cast("string"))}).collect()]


def in_order(rows):
    return sorted(rows, key=repr)


def test_manifest_equals_plain_trees(spark):
    rows = [(i, f"text {i} ß", ("en", "de", "fr", None, "")[i % 5] if i > 700 else "en", "s", i) for i in range(1300)]
    rows += [(None, None, None, None, None), (5, "", "é", "", 2**63 - 1), rows[3], rows[3], (3, "other", "en", "s", None), (7, "x" * 200_000, "zz", "", 0)]
    assert in_order(manifest_of(spark, rows)) == in_order(plain_manifest(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4097])
def test_manifest_of_one_group(spark, n):
    rows = [(i, str(i), "en", "s", 1) for i in range(n)]
    got = manifest_of(spark, rows)
    assert in_order(got) == in_order(plain_manifest(rows))


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, []) == []


def test_no_copy_of_a_node_serves_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SHARE", 4)
    leaves = spark.range(700).select(F.lit("g").alias("grp"), F.col("id").alias("key"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    numbered = materialise(merkle._numbered(leaves.withColumn("tampered", F.col("leaf"))), "numbered")
    rows, nodes, _ = merkle.build_trees(numbered, levels=2)
    at = {(r.tree, r.hop, r.idx, r.copy): r for r in nodes.collect()}
    met = Counter()
    for leaf in rows.collect():
        row = leaf
        while row.up_tree is not None:
            place = (row.up_tree, row.up_hop, row.up_idx, leaf.idx % row.up_copies)
            met[place] += 1
            row = at[place]
    assert max(met.values()) <= 5 and set(met) == set(at)
    proven = merkle.prove(leaves.withColumn("tampered", F.col("leaf")), levels=2)
    assert proven.filter("folded = root").count() == 700 and proven.select("root").distinct().count() == 1


def plain_variants(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        others = [o for o in words if o != w and near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (n, len(others))
    result = []
    for w, (n, near_count) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        result.append((w, form[w], root, n, near_count, words[form[w]] if form[w] else None))
    return result


def variants_of(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], DOCS + ", word string, n long, rest string")
    return [tuple(r) for r in spelling.spelling_variants(docs).collect()]


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 300)
    dice = random.Random(2)
    base = ["information", "informativ", "élégance", "übertragung", "aaaaaaaa", "Strasse×straße", "abcdefg"]
    rows = [(None, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "short 123 !!", "en", "s", 0)]
    for i in range(3, 120):
        words = []
        for _ in range(60):
            word = dice.choice(base)
            if dice.random() < 0.2:
                at = dice.randrange(len(word) + 1)
                word = dice.choice([word[:at] + word[at + 1 :], word[:at] + dice.choice("aéz") + word[at:], word[:at] + dice.choice("aéz") + word[at + 1 :]])
            words.append(word if dice.random() < 0.8 else word.upper())
        rows.append((i if i % 9 else None, dice.choice([" ", "-", "\n1"]).join(words), "en", "s", 0))
    rows += [rows[5], rows[5]]
    want = plain_variants(rows)
    assert in_order(variants_of(spark, rows)) == in_order(want)
    assert any(r[1] for r in want) and any(r[4] > 1 for r in want)


def test_crowded_chunks_are_split(spark):
    """Hundreds of words share a half; none may be lost and pairs must not be all of them."""
    dice = random.Random(4)
    tails = {"".join(dice.choice("abcd") for _ in range(5)) for _ in range(400)}
    words = ["prefix" + t for t in tails] + [t + "ending" for t in tails] + ["prefix" + t + "q" for t in list(tails)[:50]]
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(words), "en", "s", 0)]
    assert in_order(variants_of(spark, rows)) == in_order(plain_variants(rows))


@pytest.mark.parametrize("limit", [None, 0])
def test_words_are_not_broadcast_however_small_their_file(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(spelling, "BROADCAST_ROWS", limit)
    plans = []
    write = spelling.WorkTables.write

    def spy(self, df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, label)

    monkeypatch.setattr(spelling.WorkTables, "write", spy)
    dice = random.Random(6)
    words = ["prefix" + "".join(dice.choice("abcd") for _ in range(5)) for _ in range(150)]
    rows = [(i, " ".join(words + ["abcdefgh"] * i), "en", "s", 0) for i in range(1, 12)]
    docs = spark.createDataFrame(rows, DOCS)
    result = spelling.spelling_variants(docs)
    assert in_order(tuple(r) for r in result.collect()) == in_order(plain_variants(rows))
    joins = [line for plan in [*plans, result._jdf.queryExecution().executedPlan().toString()] for line in plan.splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in line for line in joins) >= 6
    # Only the list of crowded chunks, whose rows are counted.
    assert all("LeftAnti" in line or "LeftSemi" in line for line in joins if "Broadcast" in line)
    assert limit is None or not any("Broadcast" in line for line in joins)


def test_forms_are_followed_to_the_root(spark):
    text = " ".join(["abcdefgh"] * 2 + ["abcdefgi"] * 30 + ["abcdefii"] * 400)
    got = {r[0]: r for r in variants_of(spark, [(4, text, "en", "s", 0)])}
    assert in_order(got.values()) == in_order(plain_variants([(4, text)]))
    assert variants_of(spark, []) == []


def test_forms_of_forms(spark):
    told = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)], "word string, form string")
    assert {r.root for r in spelling._roots(told).collect()} == {"w11"}
    assert spelling._roots(told.limit(0)).count() == 0

"""Line dedup, URL filters, licence scans and mixing on small tables with nulls, ties, repeats and clashing names."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import license_scan, license_texts, line_dedup, mixing, url_filter

HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, runs string, removed int, start int"


def line_rows(seed, n):
    r = random.Random(seed)
    lines = [f"line {k} {'x' * (k % 5)}" for k in range(9)] + ["", "  "]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(0, 9)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "a\nb\n\nc\nd"), (n + 4, "z\na\nb\n\nc\nd\n"), (None, "q1\nq2\nq3"), (n + 5, "q1\nq2\nq3"), (3, rows[3][1])]


def brute_lines(rows, m):
    place = lambda i: (1 << 63) - 1 if i is None else i
    content = [[(k, x) for k, x in enumerate((t or "").split("\n")) if HAS_WORD.search(x)] for _, t in rows]
    first = {}
    for (i, _), c in zip(rows, content, strict=True):
        for k in range(len(c) - m + 1):
            key = tuple(x for _, x in c[k : k + m])
            first[key] = min(first.get(key, (math.inf, 0)), (place(i), k))
    out = Counter()
    for (i, t), c in zip(rows, content, strict=True):
        gone = set()
        for k in range(len(c) - m + 1):
            if (place(i), k) > first[tuple(x for _, x in c[k : k + m])]:
                gone.update(range(k, k + m))
        lines, kept, fate = (t or "").split("\n"), [], False
        number = {at: k for k, (at, _) in enumerate(c)}
        for at, x in enumerate(lines):
            if at in number:
                fate = number[at] in gone
            if not fate:
                kept.append(x)
        out[(i, "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("seed,m", [(1, 2), (2, 3), (3, 1), (4, 5)])
def test_line_dedup_against_brute_force(spark, seed, m):
    rows = line_rows(seed, 60)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "r", 2, 3) for i, t in rows], DOCS).repartition(5)
    out = line_dedup.dedup_lines(docs, m)
    assert out.columns == [*docs.columns, "removed_runs"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute_lines(rows, m)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_long_single_lines_are_runs(spark):
    long = " ".join(f"w{k}" for k in range(50))
    short = " ".join(f"v{k}" for k in range(49)) + " " * 80
    rows = [(1, long), (2, f"a\n{long}\nb"), (3, f"c\n{short}\n{long}\n\nd\ne"), (4, f"{short}\nf\n{long}"), (None, f"g\n{long}\n{long}"), (5, f"x\ny\n{long}"), (6, f"x\ny\n{long}\nz")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "r", 2, 3) for i, t in rows], DOCS).repartition(3)
    want = {1: long, 2: "a\nb", 3: f"c\n{short}\nd\ne", 4: f"{short}\nf", None: "g", 5: "x\ny", 6: "z"}
    out = line_dedup.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert {r.doc_id: [tuple(x) for x in r.removed_runs] for r in out} == {1: [], 2: [(1, 1)], 3: [(2, 2)], 4: [(2, 1)], None: [(1, 2)], 5: [(2, 1)], 6: [(0, 3)]}
    again = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_words=None).collect()}
    assert again == dict(rows) | {6: "z"}


def test_ranks_are_the_order_of_suffixes(spark):
    """Places that share h lines have ranks in the order of their line ids, equal ones if and only if the lines are."""
    r = random.Random(11)
    rows = [(k, "\n".join(r.choice("abc") for _ in range(r.randint(0, 12)))) for k in range(40)]
    docs = line_dedup._prepared(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    ids = {x.line: (x.a, x.b) for x in spark.createDataFrame([(c,) for c in "abc"], "line string").select("line", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b")).collect()}
    seen = []
    for h, places in line_dedup.suffix_intervals(docs, "text"):
        got = {(x[f"{line_dedup.P}id"], x["at"]): (x["rank"], x["copy"]) for x in places.collect()}
        want = defaultdict(list)
        for k, t in rows:
            lines = t.split("\n") if t else []
            for at in range(len(lines) - h + 1):
                want[tuple(ids[x] for x in lines[at : at + h])].append((k, at))
        want = {prefix: sorted(x) for prefix, x in want.items() if len(x) > 1}
        assert set(got) == {p for x in want.values() for p in x}
        order = sorted(want)
        ranks = [{got[p][0] for p in want[prefix]} for prefix in order]
        assert all(len(x) == 1 for x in ranks)
        assert [x for (x,) in ranks] == sorted({x for (x,) in ranks})
        assert all(got[p][1] == (k > 0) for x in want.values() for k, p in enumerate(x))
        seen.append(h)
    assert seen[:3] == [1, 2, 4]


def test_a_clashing_column_is_kept(spark):
    rows = [(1, "a\nb", 7, "x"), (2, "a\nb", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_runs int, mix_key string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "removed_runs_"] and {r.doc_id: (r.removed_runs, len(r.removed_runs_)) for r in out.collect()} == {1: (7, 0), 2: (8, 1)}
    assert line_dedup.dedup_lines(docs, runs_col=None).columns == docs.columns
    mixed = mixing.mix(docs.withColumns({"mix_copy": F.lit(5), "source": F.lit("s")}))
    assert mixed.columns == [*docs.columns, "mix_copy", "source", "mix_copy_", "mix_key_"]
    assert all(r.mix_copy == 5 and r.mix_key in ("x", None) for r in mixed.collect())


def brute_url(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h), len(p), -k, h + p, a) for k, (a, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, max(fits)[4] if fits else "allow"


def test_url_filter_against_brute_force(spark):
    r = random.Random(6)
    rules = url_filter.RULES + [("block", "b.c.example.com", "/"), ("allow", "c.example.com", "/en/x"), ("block", "xample.com", "/"), ("allow", "net", "/es/ok"), ("block", "net", "/es/ok"), ("block", "org", "")]
    hosts = ["com", "example.com", "WWW.Example.com", "b.c.example.com", "z.b.c.example.com", "xample.com", "example.com.", "net", "a.net", "aorg", "x.org", "", ".com", "é.com"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/x', '/es/ok', '/es/', '/fr/1', '?q=/en/', '#/en/'])}{r.choice(['', '?a', '#b', '/c'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "://com/", "http://a.com/x://net/es/", "http://example.com/en/\nx", "http://net" + "/es" * 5000]
    rows = [(k, u, "h", "p", "k") for k, u in enumerate(urls)] + [(0, urls[0], "h", "p", "k"), (None, urls[1], "h", "p", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, stack string").repartition(4)
    got = url_filter.judge_urls(pages, spark.createDataFrame([(*x, k) for k, x in enumerate(rules)], url_filter.RULE))
    assert Counter(map(tuple, got.collect())) == Counter((i, *brute_url(u, rules)) for i, u, *_ in rows)
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame([(*x, k) for k, x in enumerate(rules)], url_filter.RULE)).count() == 0


def test_licences_are_found_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License"), (2, "a/b/x.txt", "prose\nno terms"), (3, "a/b/c/LICENSE.md", "Licensed under the Apache License, Version 2.0"), (4, "a/b/c/d/y.txt", None), (5, "z/w.txt", "words"),
        (6, "z/v.txt", "text\n  This work is licensed under the GNU General Public License, version 3.\nmore"), (7, "LICENSE-old", "copyright of nobody in particular"), (8, None, ""), (9, "ab/x.txt", "near a, not below it"), (2, "a/b/x.txt", "prose\nno terms"), (None, "a/q", "x"),
    ]
    files = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, path string, text string, name string, dir int").repartition(3)
    templates = spark.createDataFrame(license_texts.templates(), "name string, body string")
    out = license_scan.scan_licenses(files, templates)
    got = Counter((r.doc_id, r.own_license, r.license, r.license_dir) for r in out.collect())
    assert got == Counter(
        [(1, "MIT", "MIT", None), (2, None, "MIT", "a"), (2, None, "MIT", "a"), (3, "Apache-2.0", "Apache-2.0", None), (4, None, "Apache-2.0", "a/b/c"), (5, None, None, None), (6, "GPL-3.0", "GPL-3.0", None), (7, None, None, None), (8, None, None, None), (9, None, None, None), (None, None, "MIT", "a")]
    )
    assert license_scan.scan_licenses(files.limit(0), templates).count() == 0


def test_real_licence_files_and_headers(spark):
    mit = license_texts.MIT.replace("Copyright (c)", "Copyright (c) 2021 Ada Example and contributors")
    comment = lambda t, mark: "\n".join(f"{mark} {x}" if x else mark for x in t.split("\n"))
    text = "\n\n".join(f"def f{k}(x):\n    return x + {k}" for k in range(40))
    apache = "Copyright 2019 Some Company\n\n" + license_texts.APACHE_HEADER
    rows = [
        (1, "a/LICENSE", mit, "MIT"), (2, "b/LICENSE.txt", (license_texts.FOLDER / "Apache-2.0.txt").read_text(), "Apache-2.0"), (3, "c/COPYING", (license_texts.FOLDER / "GPL-3.0.txt").read_text(), "GPL-3.0"),
        (4, "d/x.py", comment(apache, "#") + "\n\n" + text, "Apache-2.0"), (5, "d/y.c", "// SPDX-License-Identifier: MIT\n" + text, "MIT"), (6, "d/z.js", "/*\n" + comment(license_texts.MPL_HEADER, " *") + "\n */\n\n" + text, "MPL-2.0"),
        (7, "e/LICENSE", license_texts.NOTICES["BSD-3-Clause"][0].replace("(c)", "(c) 2001 University of Somewhere"), "BSD-3-Clause"), (8, "f/LICENSE", license_texts.NOTICES["BSD-2-Clause"][0], "BSD-2-Clause"),
        (9, "g/q.rs", "// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), (10, "g/r.rs", "// SPDX-License-Identifier: Nobody-1.0", None), (11, "g/s.py", text + "\nprint('the license plate of a car')", None),
        (12, "h/m.go", comment(license_texts.gnu_header("GNU Lesser General Public License", "3"), "//"), "LGPL-3.0"), (13, "h/n.py", comment(mit, "#") + "\n" + text, "MIT"),
        (None, None, "Released under the MIT License", "MIT"), (None, None, "nothing", None), (None, None, None, None),
    ]
    files = spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string").repartition(3)
    out = license_scan.scan_licenses(files, spark.createDataFrame(license_texts.templates(), "name string, body string"))
    assert Counter((r.doc_id, r.own_license) for r in out.collect()) == Counter((r[0], r[3]) for r in rows)


def test_many_path_rules_of_a_host(spark):
    r = random.Random(12)
    paths = sorted({"/" + "/".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(2000)})
    rules = [(r.choice(["allow", "block"]), r.choice(["h.org", "h.org", "x.h.org", "org"]), p, k) for k, p in enumerate(paths)]
    urls = [(k, f"http://{r.choice(['h.org', 'x.h.org', 'y.x.h.org', 'org'])}/" + "/".join(r.choice("ab") for _ in range(r.randint(0, 11)))) for k in range(300)]
    # characters that separate keys, and the largest one
    rules += [("block", "a\x01b", "/", 9000), ("allow", "b.a", "/\U0010ffff", 9001), ("block", "b.a", "/", 9002)]
    urls += [(400, "http://b.a/\U0010ffffz"), (401, "http://a\x01b/q"), (402, "http://b.a/q")]
    got = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, url_filter.RULE))
    assert sorted(map(tuple, got.collect())) == sorted((i, *brute_url(u, [x[:3] for x in rules])) for i, u in urls)


def test_poisson_inversion(spark):
    for mean in (0.0, 0.14, 1.0, 7.5, 16.0):
        rows = spark.range(4000).select(F.col("id"), mixing.uniform(F.lit(3), F.lit(0), F.col("id")).alias("u")).select("u", mixing.poisson(F.col("u"), F.lit(mean)).alias("k")).collect()
        for r in rows[:300]:
            p = c = math.exp(-mean)
            k = 0
            while c < r.u:
                k += 1
                p *= mean / k
                c += p
            assert k == r.k
        assert abs(sum(r.k for r in rows) / len(rows) - mean) < 5 * math.sqrt(max(mean, 0.01) / len(rows))


def test_sources_reach_their_weights(spark):
    r = random.Random(1)
    source = lambda k: None if k % 50 == 0 else f"s{min(int(r.expovariate(0.5)), 5)}"
    rows = [(k, None if k % 9 == 0 else f"t{k}", "en", source(k), 1, "", 0, 0) for k in range(6000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    weights = {"s0": 1.0, "s1": 2.0, "s2": 0.0, "s5": 40.0}
    out = mixing.mix(docs, weights, other=3.0, size=2.0)
    got = Counter(r.source for r in out.collect())
    names = {r[3] for r in rows}
    total = sum(weights.get(n, 3.0) for n in names)
    for n in names:
        want = 2.0 * len(rows) * weights.get(n, 3.0) / total
        assert abs(got[n] - want) < 6 * math.sqrt(want * (1 + want / sum(x[3] == n for x in rows))) + 1
    again = mixing.mix(docs.repartition(9), weights, other=3.0, size=2.0)
    assert sorted(map(str, out.drop("runs").collect())) == sorted(map(str, again.drop("runs").collect()))
    keys = [r.mix_key for r in out.collect()]
    assert keys == sorted(keys) and out.columns == [*docs.columns, "mix_copy", "mix_key"]
    assert mixing.mix(docs.limit(0)).count() == 0
    copies = defaultdict(int)
    for r in out.collect():
        copies[r.doc_id] = max(copies[r.doc_id], r.mix_copy)
    assert sum(copies.values()) == len(keys)

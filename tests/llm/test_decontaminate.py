"""Tiling against brute force, and leaks whole and reordered."""

import random

from quillon.llm import decontaminate as d


def brute_tiles(a, b, minimum):
    """The longest common substring of unmarked words, marked, until none is long enough; ties: first in a, then in b."""
    ma, mb, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < minimum:
            return sorted(tiles)
        tiles.append((i, j, n))
        ma[i : i + n] = [True] * n
        mb[j : j + n] = [True] * n


def test_tiling_is_strictly_greedy():
    r = random.Random(3)
    total = 0
    for k in range(4000):
        m, kinds = r.randint(2, 5), r.randint(1, 5)
        a = [r.randint(0, kinds) for _ in range(r.randint(0, 14))]
        b = [r.randint(0, kinds) for _ in range(r.randint(0, 20))]
        if k % 20 == 0:
            # long, with shuffled and broken copies of parts
            a = [r.randint(0, 30) for _ in range(40)]
            b = sum((a[x : x + r.randint(3, 20)] + [99] * r.randint(0, 1) for x in r.sample(range(35), 4)), [])
        want = brute_tiles(a, b, m)
        assert sorted(d.tile(a, b, m)) == want, (a, b, m)
        total += len(want)
    assert total > 1500


def test_leaks_and_clean_documents(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(6))
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(30) for _ in range(6)] + [prose(4), prose(12)]
    rows = []
    for k in range(60):
        body = prose(r.randint(0, 80))
        rows.append((k, " ".join(body), None))
    leak = {}
    for k, item in enumerate(items[:6]):
        mixed = item[15:] + prose(3) + item[:15] if k % 2 else [w.upper() + "," for w in item]
        rows.append((100 + k, " ".join(prose(20) + mixed + prose(9)), "x"))
        leak[100 + k] = k
    rows.append((200, " ".join(items[0][:20]), None))  # two thirds: no leak
    rows.append((201, " ".join(items[6]), None))  # below a seed
    rows += [(300, None, None), (301, "", None), (302, "... ;", None), (100, rows[60][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in enumerate(items)] + [(99, None, 1), (98, "", 1)], "item_id long, text string, doc_id int")
    for block in (d.BLOCK, 400):
        got = [(x.doc_id, x.item_id) for x in d.find_leaks(docs, bench, block=block).collect()]
        assert sorted(got) == sorted([*leak.items(), (100, 0)])
        kept = d.clean_documents(docs, bench, block=block)
        assert kept.columns == docs.columns
        assert sorted(map(str, (x.doc_id for x in kept.collect()))) == sorted(str(i) for i, *_ in rows if i not in leak)
    tiles = [x for x in d.find_leaks(docs, bench).collect() if x.doc_id == 101][0]
    assert tiles.coverage == 1.0 and len(tiles.tiles) == 2
    assert d.find_leaks(docs.limit(0), bench).count() == 0 and d.find_leaks(docs, bench.limit(0)).count() == 0
    assert d.clean_documents(docs, bench.limit(0)).count() == len(rows)
    twice = bench.filter("item_id = 2").unionByName(bench.filter("item_id = 2"))
    assert [(x.doc_id, x.item_id) for x in d.find_leaks(docs, twice).collect()] == [(102, 2)] * 2

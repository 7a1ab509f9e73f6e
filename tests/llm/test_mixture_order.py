"""A mixture tells the order of its documents."""

import collections

from airtoll.llm import mixing


def test_mixture_is_a_permutation(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table, budget_share=0.5, entropy=1.0, block_tokens=100).collect()
    blocks = collections.defaultdict(set)
    for r in got:
        blocks[r["source"], r["block_rank"]].add(r["block"])
    assert all(len(b) == 1 for b in blocks.values())
    for source in "ab":
        ranks = [b for s, b in blocks if s == source]
        assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) > 5
        mine = sorted((r["block_rank"], r["place"], r["copies"]) for r in got if r["source"] == source)
        copies = [c for _, _, c in mine]
        assert len({m[:2] for m in mine}) == 300 and copies == sorted(copies, reverse=True) and set(copies) == {0, 1}


def test_what_is_missing_is_less_than_any_document_left(spark):
    """Long documents are passed over, and the shortest ones of other blocks fill what is left."""
    sizes = [[900, 40, 7, 3, 2, 1][i % 6] + i % 5 for i in range(3000)]
    rows = [(i, "w " * n, "abc"[i % 7 % 3]) for i, n in enumerate(sizes)] + [(9000, None, "a"), (9001, "", "c"), (9002, "w w", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, block_tokens in ((0.37, 2000), (1.9, 100_000)):
        got = mixing.mix(table, budget_share=share, repeats=2.0 if share > 1 else 1.0, block_tokens=block_tokens).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r["source"]].append(r)
        total = sum(sizes) + 2
        for source, mine in by.items():
            whole = min(r["copies"] for r in mine)
            target = mine[0]["weight"] * share * total
            missing = target - sum(r["copies"] * r["n_tokens"] for r in mine)
            left = [r["n_tokens"] for r in mine if r["copies"] == whole]
            assert {r["shortfall"] for r in mine} == {mine[0]["shortfall"]} and abs(missing - mine[0]["shortfall"]) < 1.001
            if max(r["copies"] for r in mine) > whole:
                assert mine[0]["shortfall"] < min(left)


def test_the_search_ends_between_its_bounds(spark):
    shares = [(f"s{i}", 100 + 13 * i) for i in range(20)]
    total = sum(n for _, n in shares)
    sources = spark.createDataFrame([(k, n, float(total)) for k, n in shares], "key string, n_tokens long, total double")
    found = mixing.find_exponent(sources, 1.9, None, 2.0)
    assert 0 < found < 1

    def most(e):
        return max(1.9 * (n / total) ** (e - 1) for _, n in shares) / sum((n / total) ** e for _, n in shares)

    assert most(found) <= 2 < most(found - 1e-8)

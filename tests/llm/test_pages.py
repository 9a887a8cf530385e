"""Main text of pages: the suffix order of a host, and what it cuts."""

import random
from collections import defaultdict

import numpy as np

from voxframe.llm import pages

PAGE = "page_id long, url string, html string"


def _texts(seed, count):
    """Blocks of some pages, with short and long repeats at any place."""
    rng = random.Random(seed)
    common = [[f"c{i}w{j}" for j in range(n)] for i, n in enumerate((3, 19, 20, 21, 45, 70))]
    out = []
    for _ in range(count):
        page = []
        for _ in range(rng.randrange(5)):
            block = [rng.choice("abc") for _ in range(rng.randrange(30))]
            if rng.random() < 0.7:
                block = rng.choice(([], block)) + rng.choice(common) + rng.choice(([], block))
            page.append(block)
        out.append([b for b in page if b])
    return out


def _strings(texts):
    found = [pages.token_hashes([" ".join(b) for b in page]) for page in texts]
    return pages.strings([n for _, n in found], [h for h, _ in found])


def _suffixes(texts):
    """(page, place) -> the first tokens of a suffix that a repeat needs, from the definition."""
    out = {}
    for i, page in enumerate(texts):
        stream = [t for b in page for t in b]
        n = max(0, len(stream) - pages.DEPTH + 1)
        out |= {(i, j): tuple(stream[j : j + pages.DEPTH]) for j in range(n)}
        out |= {(i, n + k): (*b, None) for k, b in enumerate(page) if len(b) < pages.DEPTH}
    return out


def test_suffix_order_is_the_sorted_suffixes():
    for seed in range(4):
        tokens, ends, *_ = _strings(_texts(seed, 12))
        levels = pages.suffix_ranks(tokens, ends)
        reach = 1 << (len(levels) - 1)
        assert reach >= pages.DEPTH
        text = tokens.tolist()
        suffix = [text[i:z] for i, z in enumerate(ends.tolist())]
        order = np.argsort(levels[-1], kind="stable")
        assert order.tolist() == sorted(range(len(text)), key=lambda i: suffix[i][:reach])
        left, right = order[:-1], order[1:]
        for a, b, common in zip(left.tolist(), right.tolist(), pages.common_prefixes(levels, ends, left, right).tolist()):
            same = [x == y for x, y in zip(suffix[a], suffix[b])]
            assert common == min((same + [False]).index(False), 2 * reach - 1)


def test_repeats_are_all_runs_of_the_order():
    for seed in range(4):
        texts = _texts(seed, 40)
        tokens, ends, at, need, page, place = _strings(texts)
        want = _suffixes(texts)
        assert sorted(zip(page.tolist(), place.tolist())) == sorted(want)
        on = defaultdict(set)
        for (i, _), prefix in want.items():
            on[prefix].add(i)
        suffix, n = pages.repeats_of(tokens, ends, at, need, page)
        got = {want[page[s].item(), place[s].item()]: c for s, c in zip(suffix.tolist(), n.tolist())}
        assert len(got) == len(suffix)
        assert got == {prefix: len(ids) for prefix, ids in on.items()}
        assert max(got.values()) > pages.LEAST
    assert [len(x) for x in pages.repeats_of(*_strings([[], []])[:5])] == [0, 0]


def test_a_host_in_parts_has_the_repeats_of_the_whole(spark, monkeypatch):
    texts = _texts(9, 60)
    rows = [(i, f"http://h{i % 2}.example/{i}", "".join(f"<div>{' '.join(b)}</div>" for b in t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], PAGE)
    whole = sorted(map(tuple, pages.main_text(spark, df).collect()))
    monkeypatch.setattr(pages, "PART", 100)
    assert sorted(map(tuple, pages.main_text(spark, df).collect())) == whole
    # Covered tokens from the definition; windows that only chance makes go on are none of them.
    assert len(whole) == 65 and sum(r[4] > 0 for r in whole) > 30
    on, size = defaultdict(set), defaultdict(set)
    for (i, _), prefix in _suffixes(texts).items():
        on[i % 2, prefix].add(i)
    for i in range(60):
        size[i % 2].add(i)
    for i, _, _, _, n in whole:
        covered, stream, start = set(), [t for b in texts[i] for t in b], 0
        common = lambda prefix: len(on[i % 2, prefix]) >= max(pages.LEAST, pages.SHARE * len(size[i % 2]))
        for j in range(len(stream) - pages.DEPTH + 1):
            if common(tuple(stream[j : j + pages.DEPTH])):
                covered |= set(range(j, j + pages.DEPTH))
        for b in texts[i]:
            if len(b) < pages.DEPTH and common((*b, None)):
                covered |= set(range(start, start + len(b)))
            start += len(b)
        assert n <= len(covered)
        if not any(common(tuple(stream[j : j + pages.DEPTH])) for j in range(len(stream))):
            assert n == len(covered)


def test_rows_of_one_page_are_cut_by_their_own_repeats(spark):
    menu = "<div>Home of all the good things</div>"
    own = "<div>" + " ".join(f"own{i}" for i in range(40)) + "</div>"
    rows = [(i, "http://h/", f"{menu}<div>page {i} {' '.join(f'w{i}x{j}' for j in range(25))}</div>") for i in range(5)] + [(0, "http://h/", own)]
    got = [r.text for r in pages.main_text(spark, spark.createDataFrame(rows, PAGE)).collect()]
    assert sorted(got) == sorted([f"page {i} {' '.join(f'w{i}x{j}' for j in range(25))}" for i in range(5)] + [own[5:-6]])


def _words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def _mixed():
    """Pages with and without an article: a menu, a passage that articles hold, text of their own."""
    passage, menu = _words("passage", 30), _words("menu", 25)
    rows = []
    for i in range(60):
        own = _words(f"own{i}x", 40)
        inside = i % 3 > 0
        text = f"<p>{own}</p>" + (f"<p>{passage}</p>" if i % 4 < 2 else "")
        rows.append((i, "http://h/", f"<div>{menu}</div>" + (f"<article>{text}</article>" if inside else text)))
    return rows, passage, menu


def test_article_text_is_in_the_order(spark):
    rows, passage, _ = _mixed()
    got = {r.page_id: r for r in pages.main_text(spark, spark.createDataFrame(rows, PAGE)).collect()}
    for i in range(60):
        # Covered are the menu and, inside an article or not, the passage.
        assert got[i].n_repeated == 25 + 30 * (i % 4 < 2)
        # Most pages have the passage in their article, so it is no boilerplate elsewhere.
        assert got[i].text == _words(f"own{i}x", 40) + ("\n" + passage if i % 4 < 2 else "")


def test_parts_of_a_host_count_what_any_of_them_names(spark, monkeypatch):
    rows, _, _ = _mixed()
    # On exactly the least share of the pages, which no part need have on LEAST of its own.
    rows = [(i, u, h + (f"<div>{_words('rare', 22)}</div>" if i < 3 else "")) for i, u, h in rows]
    df = spark.createDataFrame(rows + rows[:7], PAGE)
    whole = sorted(map(tuple, pages.main_text(spark, df).collect()))
    assert {r[4] for r in whole if r[0] == 2} == {25 + 22}
    monkeypatch.setattr(pages, "PART", 50)
    monkeypatch.setattr(pages, "FEW", 4)
    assert sorted(map(tuple, pages.main_text(spark, df).collect())) == whole


def test_rows_without_id_are_ordered_too(spark):
    rows, passage, _ = _mixed()
    rows = [(None if i % 3 == 0 else i, u, h) for i, u, h in rows]
    got = [r for r in pages.main_text(spark, spark.createDataFrame(rows + rows[:1], PAGE)).collect() if r.page_id is None]
    want = [_words(f"own{i}x", 40) + ("\n" + passage if i % 4 < 2 else "") for i in [*range(0, 60, 3), 0]]
    assert sorted(r.text for r in got) == sorted(want)
    assert {r.n_repeated for r in got} == {25, 55}


def test_blocks_are_dealt_once(spark):
    rows, _, _ = _mixed()
    out = pages.main_text(spark, spark.createDataFrame(rows, PAGE))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("Initial Plan")] if "Initial Plan" in plan else plan
    # The texts of a host move once; its three uses read the same shuffle.
    assert final.count("_parsed(") == 1

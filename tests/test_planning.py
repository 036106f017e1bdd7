from __future__ import annotations

import random

import pytest

from scriptorium.operators import folds, planning

TOPICS = "g string, at long, title string, words long"


def fold(rows, days):
    """Day of each topic by the sequential rule, and minutes of two hours a day."""
    out, review = {}, max(1, int(days / 6 + 0.5)) if days >= 3 else 0
    groups = {}
    for g, at, title, w in sorted(rows, key=lambda r: (str(r[0]), *r[1:])):
        groups.setdefault(g, []).append((at, title, w))
    for g, topics in groups.items():
        day = folds.day_numbers([w for *_, w in topics], max(1, days - review))
        load = {d: sum(w for (*_, w), x in zip(topics, day, strict=True) if x == d) for d in day}
        m = [max(5, int(105 * w / max(load.values()) + 0.5)) for *_, w in topics]
        for (at, title, _), d, x in zip(topics, day, m, strict=True):
            total = sum(y for y, e in zip(m, day, strict=True) if e == d)
            out[g, at, title] = (d + 1, max(5, x * 105 // total) if total > 105 else x)
    return out


def made(seed):
    r = random.Random(seed)
    rows = [(f"g{k}", i, f"t{i}", r.choice([1, 3, 50, 400, 5000])) for k, n in enumerate([1, 2, 5, 9, 60, 300]) for i in range(n)]
    return rows + [("same", 1, f"t{i}", 10) for i in range(20)] + [(None, i, "x", 7) for i in range(8)]


@pytest.mark.parametrize("limit", [0, 50_000])
@pytest.mark.parametrize("days", [1, 2, 7, 23])
def test_days_equal_the_sequential_rule(spark, monkeypatch, limit, days):
    """By arrays, and by rounds in which no task holds a plan."""
    monkeypatch.setattr(planning, "FOLD", limit)
    rows = made(days)
    got = planning.plan(spark.createDataFrame(rows, TOPICS).repartition(7), "g", "at", days).collect()
    assert {(r["g"], r["at"], r["title"]): (r["day"], r["minutes"]) for r in got} == fold(rows, days) and len(got) == len(rows)


def test_two_level_sums(spark):
    rows = made(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges stay small and a plan lies in several
    try:
        got = planning.numbered(spark.createDataFrame(rows, TOPICS), "g", ["at"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    by = {}
    for r in sorted(got, key=lambda r: (str(r["g"]), r["pos"])):
        n, total = by.get(r["g"], (0, 0))
        assert (r["pos"], r["before"]) == (n, total)
        by[r["g"]] = (n + 1, total + r["words"])


def topics(pages):
    """Sections of one document's pages by the rule: headings that open a page start one."""
    from pyspark.sql import functions as F  # noqa: F401

    heads = lambda x: x.startswith("H")
    out = []
    for p, text in enumerate(pages):
        lines = [x for x in text.split("\n") if x.strip()]
        lead = 0
        while lead < len(lines) and heads(lines[lead]):
            lead += 1
        if lead:
            out.append([lines[lead - 1], p, {}])
        if lines[lead:]:
            if not out:
                out.append([None, p, {}])
            out[-1][2][p] = sum(len(x.split()) for x in lines[lead:]) + 1
    out = [t for t in out if t[2]]
    if not any(x.strip() for x in pages):
        return [(None, p, {p: 1}) for p in range(len(pages))]
    return [tuple(t) for t in out]


def test_topics_of_pages(spark):
    docs = {1: ["H one\nbody of it here.\nmore text.", "goes on here.\nH inside\nand on.", "H two\nH three\nlast words."], 2: ["no heading at all here.", ""], 3: ["", " \n"], 4: ["H only"], 5: ["H a", "H b\ntext of b."]}
    flat = [(d, p, t) for d, pages in docs.items() for p, t in enumerate(pages)]
    got = planning.topics_of(spark.createDataFrame(flat, "doc_id long, page int, text string")).collect()
    for d, pages in docs.items():
        want = topics(pages)
        mine = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["topic"])
        assert [{p["page"]: p["words"] for p in r["pages"]} for r in mine] == [t[2] for t in want]
        assert [r["first"] for r in mine] == [min(t[1], min(t[2])) for t in want]
        assert all(t[0] is None or r["title"].lower() == t[0].lower() for r, t in zip(mine, want, strict=True))


def test_a_plan_over_several_documents(spark):
    text = {1: ["H alpha\n" + "word " * 300, "H beta\n" + "word " * 900, "word " * 900], 2: ["plain " * 40], 3: ["H gamma\n" + "word " * 500]}
    pages = spark.createDataFrame([(d, p, t) for d, ps in text.items() for p, t in enumerate(ps)], "doc_id long, page int, text string")
    members = spark.createDataFrame([("p", 0, 3), ("p", 1, 1), ("q", 0, 1), ("q", 1, 2)], "plan string, position int, doc_id long")
    rows = sorted(planning.multi_plan(pages, members, 7).collect())
    p = [(r["position"], r["doc_id"], r["topic"], r["part"], r["start"], r["end"], r["words"]) for r in rows if r["plan"] == "p"]
    # the share of a day is (501 + 301 + 1802) / 6: beta is cut at its pages
    assert p == [(0, 3, 1, 0, 0, 0, 501), (1, 1, 1, 0, 0, 0, 301), (1, 1, 2, 0, 1, 1, 901), (1, 1, 2, 1, 2, 2, 901)]
    titles = [r["title"] for r in rows if r["plan"] == "p"]
    assert titles[1:] == ["H alpha", "H beta", "H beta (part 2)"] and titles[0] == "H gamma"
    days = [r["day"] for r in rows if r["plan"] == "p"]
    assert days == sorted(days) and set(days) == set(range(1, max(days) + 1))
    assert {r["plan"] for r in rows} == {"p", "q"}
    said = planning.practice(planning.multi_plan(pages, members, 7), spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "doc_id long, name string")).where("plan = 'p' AND day = 1").first()
    assert said["practice"] == "Practise the 2- and 5-mark questions for C."
    with pytest.raises(ValueError):
        planning.multi_plan(pages, members, 0)


def test_review_days_say_what_to_do(spark):
    found = planning.review_days(planning.plan(spark.createDataFrame([("g", 1, "t", 5)], TOPICS), "g", "at", 4), "g", 4).orderBy("day").collect()
    assert [r["day"] for r in found] == [2, 3, 4] and [r["title"].startswith("Final") for r in found] == [False, False, True]

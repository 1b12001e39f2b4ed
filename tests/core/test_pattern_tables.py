"""Tables of patterns against trying each pattern on each line, and the literals that patterns need."""

import random
import re

import pyarrow as pa

from sigrel.operators import text_jobs as tj

CASES = {
    "abc": ["abc"], "abc.def": ["abc", "def"], "abc?d": ["ab", "d"], "ab+c": ["ab", "c"], "ab*": ["a"], "x{2,3}yz": ["yz"], "a|b": [], "(a|b)cd": ["cd"],
    r"\d+ rows\.": [" rows."], "[a-c]de[^]x]f": [], "[a-c]defg": ["defg"], "(?i)abc": [], r"\Qa.b\Ec": [], r"a\[b": ["a[b"], "": [], "((x)y)?zz": ["zz"], "[a&&[b]]c": [],
    "é漢字.": ["é漢字"], "(?:abc)+d": ["d"], r"abc\x41": [], "(?<n>ab)c": ["c"], "abc)": ["abc"],
}


def test_required_literals():
    for pattern, want in CASES.items():
        assert tj.required_literals(pattern) == want, pattern


def test_matches_hold_their_literals():
    rng = random.Random(3)
    atoms = ["a", "b", "ab", "ba", ".", "a?", "b*", "a+", "(ab)?", "(a|b)", "[ab]", "a{1,2}", "[^a]", r"\w"]
    for _ in range(400):
        p = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 6)))
        s = "".join(rng.choice("ab ") for _ in range(12))
        m = re.search(p, s)
        if m:
            assert all(r in m[0] for r in tj.required_literals(p)), (p, s)


def test_table_equals_each_pattern_on_each_line(spark):
    rng = random.Random(9)
    words = ["error", "warn", "ok", "disk 7", "été", "漢字かな", "a.b", "x", "𝒳𝒴𝒵 𝒳"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))) for _ in range(200)] + ["", "error " * 5000 + "fatal", "a error"]
    patterns = ["err.r ok", "^warn", r"disk \d ok$", "é", "漢字かな x", r"a\.b|nothing", "(?i)WARN x", "fatal", "zzz none", "𝒵 𝒳 𝒳", "[ae]rror x", r"x x$", "x x$"]
    rows = [(i, v) for i, v in enumerate([*lines, *lines[:20]])] + [(1000, None)]
    df = spark.createDataFrame(rows, "n long, value string")
    table = spark.createDataFrame([(p, "extra") for p in [*patterns, None]], "pattern string, grams string")
    hit = {r["n"] for r in df.where(" or ".join(f"value rlike r'{p}'" for p in patterns)).collect()}
    assert 20 < len(hit) < 200
    assert sorted(r["n"] for r in tj.filter_lines(df, table, invert=True).collect()) == sorted(hit)
    assert sorted(r["n"] for r in tj.filter_lines(df, table).collect()) == sorted({n for n, _ in rows} - hit)
    none = table.where("pattern = 'no'")
    assert tj.filter_lines(df, none).count() == len(rows) and tj.filter_lines(df, none, invert=True).count() == 0
    assert tj.filter_lines(df.limit(0), table).count() == 0


def test_patterns_with_literals_need_no_loop(spark):
    lines = spark.range(1000).selectExpr("concat('line ', id, ' of many') as value")
    table = spark.createDataFrame([("line 7.* of",), ("many$",)], "pattern string")
    plan = tj.filter_lines(lines, table)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_lines_are_not_shuffled(spark):
    lines = spark.range(1000).selectExpr("concat('line ', id, ' of many') as value")
    table = spark.createDataFrame([("line 7.* of",), ("many[0-9]$",)], "pattern string")
    for invert in (False, True):
        out = tj.filter_lines(lines, table, invert)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == (111 if invert else 889)


def test_larger_tables_meet_lines_in_a_join(spark, monkeypatch):
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(["disk 7 ok", "disk ok", None, "", "ok 7", "disk 9 ok", "disk 7 ok"])], "n long, value string")
    table = spark.createDataFrame([(r"disk \d ok$",), ("^ok",), (None,)], "pattern string")
    for most in (4 << 20, 8):
        monkeypatch.setattr(tj, "PATTERN_BYTES", most)
        assert sorted(r["n"] for r in tj.filter_lines(lines, table, invert=True).collect()) == [0, 4, 5, 6]
        assert sorted(r["n"] for r in tj.filter_lines(lines, table).collect()) == [1, 2, 3]


def test_lookup_holds_what_a_search_finds(monkeypatch):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcé漢 ") for _ in range(rng.randrange(0, 30))) for _ in range(400)] + [None, "", "abc", "ab", "c"]
    patterns = ["abc", "abcab.+é漢 ", "é漢a", "aaaaaaaaaa", "bca.*abc?b", "cab[0-9]?bca", "漢 漢 漢 漢"]
    literals = {p: [r.encode()[: tj.RUN] for r in tj.required_literals(p) if len(r) >= tj.GRAM] for p in patterns}
    want = [[p for p in sorted(patterns) if v is not None and all(r in v.encode() for r in literals[p])] for v in lines]
    assert sum(map(len, want)) > 20
    for look, held in ((tj.LOOK, tj.HELD), (5, 9)):
        monkeypatch.setattr(tj, "LOOK", look)
        monkeypatch.setattr(tj, "HELD", held)
        of = tj._lookup(patterns)
        for a in (pa.array(lines), pa.array(["abc", *lines, "abc"]).slice(1, len(lines))):
            assert [sorted(x) for x in of(a).to_pylist()] == want
    assert of(pa.array([], pa.string())).to_pylist() == [] and of(pa.array([None, ""], pa.string())).to_pylist() == [[], []]

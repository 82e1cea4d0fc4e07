import pytest
from pyspark.sql import functions as F

from treeledger import functions as tf


def values(spark, column, rows, ddl="x string"):
    df = spark.createDataFrame([(r,) for r in rows], ddl)
    return [r.y for r in df.select(column.alias("y")).collect()]


def test_trailing_slashes(spark):
    given = ["/", "//", "///", "a", "a/", "a//", "/a/b//", "", "a/\n", "a\n/"]
    expected = ["/", "/", "/", "a", "a", "a", "/a/b", "", "a/\n", "a\n"]
    assert values(spark, tf.trim_trailing_slashes("x"), given) == expected


def test_leading_slashes(spark):
    assert values(spark, tf.leading_slashes("x"), ["a", "/a", "///a/", "//", ""]) == [0, 1, 3, 2, 0]


def test_relative_to(spark):
    df = spark.createDataFrame(
        [("/mnt/a/b", "/mnt"), ("/mnt//a", "/mnt/"), ("/a", "/"), ("/mntx/a", "/mnt"), ("/mnt", "/mnt")],
        "p string, r string",
    )
    got = [r.y for r in df.select(tf.relative_to("p", "r").alias("y")).collect()]
    assert got == ["a/b", "a", "a", None, ""]


def test_depth_base_parent_and_join(spark):
    given = ["a", "a/b", "é/b/c.txt", "dir/"]
    assert values(spark, tf.path_depth("x"), given) == [0, 1, 2, 1]
    assert values(spark, tf.base_name("x"), given) == ["a", "b", "c.txt", "dir"]
    assert values(spark, tf.parent_path("x"), given[:3]) == ["", "a", "é/b"]
    assert values(spark, tf.join_path("x", F.lit("r/s")), ["/", "/m", "/m/"]) == ["/r/s", "/m/r/s", "/m/r/s"]


def test_within_depth(spark):
    paths = ["a", "a/b", "a/b/c"]
    assert values(spark, tf.within_depth("x", 1), paths) == [True, True, False]
    for unlimited in (None, -1):
        assert values(spark, tf.within_depth("x", unlimited), paths) == [True] * 3
    for bad in (-2, 32768):
        with pytest.raises(ValueError):
            tf.within_depth("x", bad)


def test_change_mask_and_label(spark):
    rows = [(m, 1, 1, 1, 1 + (m & 1), 1 + (m >> 1 & 1), 1 + (m >> 2 & 1)) for m in range(8)]
    names = [f"{p}_{c}" for p in ("was", "now") for c in ("size", "ctime_ns", "mtime_ns")]
    df = spark.createDataFrame(rows, "m int, " + ", ".join(f"{n} bigint" for n in names))
    mask = tf.change_mask()
    got = df.select("m", mask.alias("mask"), tf.change_label(mask).alias("label")).collect()
    assert all(r.m == r.mask for r in got)
    assert [r.label for r in got] == [
        None,
        "size",
        "ctime",
        "size & ctime",
        "mtime",
        "size & mtime",
        "ctime & mtime",
        "size & ctime & mtime",
    ]
    assert df.select(tf.change_mask(compared=F.lit(False)).alias("y")).first().y == -1
    assert values(spark, tf.change_label(F.col("x")), [-1], "x int") == [None]


def test_format_bytes(spark):
    given = [0, 1, 1024, 1536, 4617322122555958282, -1, None, 1048576]
    expected = ["0B", "1B", "1kB", "1kB 512B", "4EB 5PB 6TB 7GB 8MB 9kB 10B", None, None, "1MB"]
    assert values(spark, tf.format_bytes("x"), given, "x bigint") == expected


def test_format_duration(spark):
    given = [0, 339800645368118513, 273522528, 1, -5, 31536000000000000 - 1]
    expected = [
        "0ns",
        "10y 9mon 1w 2d 3h 4min 5s 368ms 118μs 513ns",
        "273ms 522μs 528ns",
        "1ns",
        None,
        "11mon 4w 2d 9h 59min 59s 999ms 999μs 999ns",
    ]
    assert values(spark, tf.format_duration("x"), given, "x bigint") == expected


def test_format_time_in_any_session_zone(spark):
    given = [0, 1700000000000000042, -1, 1]
    expected = [
        "1970-01-01 00:00:00.000000000",
        "2023-11-14 22:13:20.000000042",
        "1969-12-31 23:59:59.999999999",
        "1970-01-01 00:00:00.000000001",
    ]
    for zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert values(spark, tf.format_time("x"), given, "x bigint") == expected


def test_formats_of_numbers_beyond_bigint(spark):
    def shown(form, numbers):
        given = [None if number is None else str(number) for number in numbers]
        return values(spark, form(F.col("x").cast("decimal(38,0)")), given, "x string")

    sizes = [None, 0, -1, 1 << 63, (1 << 70) + 1]
    assert shown(tf.format_bytes, sizes) == [None, "0B", None, "8EB", "1024EB 1B"]
    assert shown(tf.format_bytes, [75 * 10**18 << 60]) == [f"{75 * 10**18}EB"]
    lengths = [None, 0, -1, 1 << 63, 31_536_000_000_000_000 * 10**19 + 5]
    expected = [None, "0ns", None, "292y 5mon 2w 5d 21h 47min 16s 854ms 775μs 808ns", f"{10**19}y 5ns"]
    assert shown(tf.format_duration, lengths) == expected
    instants = [1_700_000_000 * 10**9 - (1 << 63) - 7, -(1 << 63), (1 << 63) - 1]
    expected = ["1731-08-05 22:26:03.145224185", "1677-09-21 00:12:43.145224192", "2262-04-11 23:47:16.854775807"]
    assert shown(tf.format_time, instants) == expected
    assert values(spark, tf.format_duration("x"), [1.9, -0.5, -1.5], "x double") == ["1ns", "0ns", None]


def test_format_grouped(spark):
    given = [0.0, 1e-11, 1234567.89, -1234.5, 100.0, 837452834.94, 999.0, 0.123456789]
    expected = ["0", "0", "1,234,567.89", "-1,234.5", "100", "837,452,834.94", "999", "0.123456789"]
    assert values(spark, tf.format_grouped("x"), given, "x double") == expected


def test_patterns_search_unanchored_and_dot_crosses_all_but_newline(spark):
    given = ["a\rb", "a\nb", "a b", "a\u0085b", "axb", "AXB", "pre/axb/post"]
    expected = [True, False, True, True, True, False, True]
    assert values(spark, tf.matches_any("x", ["a.b"]), given) == expected
    assert values(spark, tf.matches_any("x", []), given) == [False] * len(given)
    assert values(spark, tf.matches_any("x", ["^nope", "post$"]), given)[-1] is True


def test_include_wins_over_ignore(spark):
    given = ["src/a", "src/keep/a", "other"]
    assert values(spark, tf.is_ignored("x", ["^src/"], ["keep"]), given) == [True, False, False]
    assert values(spark, tf.is_ignored("x", [], ["keep"]), given) == [False] * 3


@pytest.mark.parametrize(
    "pattern",
    ["(", "[:digit:]", "[[:nope:]]", "(?R)", "(?1)", "(?&n)", "(?(1)a|b)", "(*FAIL)", "(?|(a)|(b))\\1", "(?U)a++", "(?J)a",
     "(a)\\g{-1}", "[a", "a\\", "(?#a", "\\C"],
)
def test_patterns_without_an_equivalent_are_refused(spark, pattern):
    with pytest.raises(ValueError):
        tf.check_patterns(["fine", pattern])


# Pattern, what it is found in, what it is not found in.
TRANSLATED = [
    ("^[[:digit:]]+$", ["12"], ["1a", ":", "d"]),
    ("^[[:^digit:]]$", ["a", ":"], ["1"]),
    ("^[a[:upper:]_]+$", ["aB_"], ["b", ":"]),
    ("^[[:word:]]$", ["a", "_", "1"], ["-"]),
    ("^[^[:space:]]$", ["a"], [" ", "\t"]),
    ("^[a[b]$", ["a", "[", "b"], ["c"]),
    ("^[a&&b]$", ["a", "&", "b"], ["c"]),
    ("^[]a]$", ["]", "a"], ["b"]),
    ("^[^]a]$", ["b"], ["]", "a"]),
    ("^[a^]$", ["a", "^"], ["b"]),
    ("^(?x) a [ #] b # end\n$", ["a b", "a#b"], ["ab"]),
    (r"a\Kb", ["ab"], ["b"]),
    ("^(?|a|b)$", ["a", "b"], ["c"]),
    ("^(?U)a+$", ["aaa"], ["b"]),
    ("^(?iU)a+$", ["AA"], ["b"]),
    (r"^\Na$", ["xa"], ["\na", "a"]),
    (r"^a\hb$", ["a b", "a\tb"], ["a\nb"]),
    (r"^a\Rb$", ["a\r\nb", "a\nb"], ["a b"]),
    ("^a{,2}$", ["", "a", "aa"], ["aaa"]),
    ("^a{x}$", ["a{x}"], ["a"]),
    ("^a{$", ["a{"], ["a"]),
    ("^a{2,3}$", ["aa", "aaa"], ["a"]),
    ("^(?P<one_x>a|b)(?P=one_x)$", ["aa", "bb"], ["ab"]),
    (r"^(?'n'a|b)\k{n}$", ["aa"], ["ab"]),
    (r"^(a|b)\g{1}0$", ["aa0", "bb0"], ["ab0"]),
    (r"^\o{101}\x{42}$", ["AB"], ["ab"]),
    ("^a(?#note)b$", ["ab"], ["a"]),
    (r"^\Qa.[b\E$", ["a.[b"], ["axb"]),
    (r"^[\Q]^\E]$", ["]", "^"], ["Q"]),
    (r"^[\b]$", ["\b"], ["b"]),
    (r"^\p{L&}$", ["a", "B"], ["1"]),
    ("(?<=a)b(?!c)(?<!x)", ["ab", "abd"], ["abc", "b"]),
    ("^(?>a+)b|c++$", ["aab", "cc"], ["d"]),
]


@pytest.mark.parametrize("pattern, found, missed", TRANSLATED)
def test_perl_patterns_keep_their_meaning(spark, pattern, found, missed):
    assert values(spark, tf.matches_any("x", [pattern]), found + missed) == [True] * len(found) + [False] * len(missed)


@pytest.mark.parametrize(
    "pattern",
    [
        r"[\[\]]",
        "[]a]",
        "[:,]",
        r"\[",
        "a{2,3}",
        r"\Q[[\E",
        "(?i)abc",
        "(?x) a b",
        r"\p{Digit}+",
        "^.*/x/.*$",
        "(?<n>a)",
        r"[^/]+\.txt",
    ],
)
def test_usable_patterns_are_accepted(spark, pattern):
    tf.check_patterns([pattern])


def test_row_digest_tells_rows_apart(spark):
    rows = [(1, "a", "bc"), (2, "ab", "c"), (3, None, "abc"), (4, "abc", None), (5, "N", "abc"), (6, "", "abc")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    assert df.select(tf.row_digest(df, ["a", "b"]).alias("d")).distinct().count() == len(rows)


def test_row_digest_of_nested_values(spark):
    rest = "named_struct('p', CAST(NULL AS INT), 'q', array(1)) AS s, X'00ff' AS b"
    a = spark.sql(f"SELECT map('x', 1, 'y', 2) AS m, {rest}")
    b = spark.sql(f"SELECT map('y', 2, 'x', 1) AS m, {rest}")
    columns = ["m", "s", "b"]
    first, second = (d.select(tf.row_digest(d, columns).alias("d")).first().d for d in (a, b))
    assert first == second

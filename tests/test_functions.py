"""Literal cases of every expression."""

import pytest
from pyspark.sql import functions as F

from sweepledger.fixed_values import RIG_FIXUP_PATH, RIG_OF_FIXUP_PATH, SHARED_FIXUP_PATH
from sweepledger.functions import labels as L
from sweepledger.functions import lines as N
from sweepledger.functions import outcomes as O
from sweepledger.functions import versions as V

c = F.col


def test_stem_cuts_one_version_suffix(values):
    labels = {
        "fixups//a:backtrace-0.3": "fixups//a:backtrace",
        "fixups//a:ark-bls12-377": "fixups//a:ark-bls12",
        "fixups//a:serde_derive": "fixups//a:serde_derive",
        "fixups//a:spki-0.8.0-rc.1": "fixups//a:spki-0.8.0-rc.1",
        "md-5": "md",
        "x-1-2": "x-1",
    }
    assert values(L.stem(c("l")), [(k,) for k in labels], "l") == list(labels.values())


def test_stem_protects_exact_names(values):
    rows = [("fixups//a:ark-bls12-377",), ("fixups//a:ark-bls12-377-0.4",), ("fixups//a:serde-1",)]
    got = values(L.stem(c("l"), ["ark-bls12-377"]), rows, "l")
    assert got == ["fixups//a:ark-bls12-377", "fixups//a:ark-bls12-377", "fixups//a:serde"]


def test_label_parts(values):
    rows = [("fixups//a/b:c-1.2#lib#x",)]
    assert values(L.strip_config(c("l")), rows, "l") == ["fixups//a/b:c-1.2"]
    assert values(L.package_of(c("l")), rows, "l") == ["fixups//a/b"]
    assert values(L.name_of(c("l")), rows, "l") == ["c-1.2"]
    assert values(L.version_of(L.name_of(c("l"))), rows, "l") == ["1.2"]
    assert values(L.version_of(c("l")), [("serde",)], "l") == [None]


SCOPES = [
    ("//third-party/...", "^fixups//third-party[/:]"),
    ("//third-party:", "^fixups//third-party:"),
    ("//third-party", "^fixups//third-party[/:]"),
    ("//third-party:x", "^fixups//third-party:x$"),
    ("//...", "^fixups/[/:]"),
]


def test_scope_regex(values):
    assert values(L.scope_regex(c("p")), [(p,) for p, _ in SCOPES], "p") == [r for _, r in SCOPES]


def test_scope_regex_takes_paths_as_they_are(values):
    rows = [("//a.b+c:", "fixups//a.b+c:x"), ("//a.b+c:", "fixups//aXb+c:x"), ("//a.b/...", "fixups//a.b/d:x"), ("//a.b/...", "fixups//acb/d:x")]
    assert values(F.regexp_like(c("l"), L.scope_regex(c("p"))), rows, "p", "l") == [True, False, True, False]


@pytest.mark.parametrize(
    "pattern, inside",
    [
        ("//third-party:", [True, False, False, False]),
        ("//third-party/...", [True, True, False, False]),
        ("//third-party", [True, True, False, False]),
        ("//third-party:x", [True, False, False, False]),
        ("//...", [True, True, True, True]),
    ],
)
def test_in_scope(values, pattern, inside):
    labels = [
        ("fixups//third-party:x",),
        ("fixups//third-party/snapshots/2025-11:x",),
        ("fixups//third-party2:x",),
        ("fixups//win:x",),
    ]
    assert values(L.in_scope(c("l"), [pattern]), labels, "l") == inside
    regex = dict(SCOPES)[pattern]
    assert values(c("l").rlike(regex), labels, "l") == inside


def test_changed_paths(values):
    rows = [
        ("fixups/serde/fixups.toml",),
        ("third-party/conflict-rigs/sqlx/fixups/quote/fixups.toml",),
        ("README.md",),
        ("fixups/README",),
        ("a/fixups/serde/fixups.toml",),
    ]
    crate = L.changed_crate(c("p"), SHARED_FIXUP_PATH, RIG_FIXUP_PATH)
    assert values(crate, rows, "p") == ["serde", "quote", None, None, None]
    rig = L.changed_rig(c("p"), RIG_OF_FIXUP_PATH)
    assert values(rig, rows, "p") == [None, "third-party/conflict-rigs/sqlx", None, None, None]


def test_missing_outcome_is_a_failure(values):
    assert values(O.not_success(c("s")), [("SUCCESS",), ("FAIL",), (None,), ("success",)], "s") == [False, True, True, True]


def test_platform_key(values):
    rows = [
        ("MINGW64_NT-10.0-20348", "x86_64", "ARM64"),
        ("MSYS_NT-10.0", "i686", "X64"),
        ("CYGWIN_NT", "x86_64", None),
        ("Linux", "x86_64", "ARM64"),
        ("Darwin", "arm64", None),
    ]
    got = values(O.platform_key(c("os"), c("arch"), c("runner")), rows, "os", "arch", "runner")
    assert got == ["Windows-aarch64", "Windows-x86_64", "Windows-x86_64", "Linux-x86_64", "Darwin-arm64"]


def test_index_is_faithful(values):
    rows = [('{"dl": "https://static.crates.io/crates"}',), ('{"dl": "https://mirror"}',), ("{}",)]
    assert values(O.index_is_faithful(c("j")), rows, "j") == [True, False, False]


def test_entries(values):
    assert values(N.is_entry(c("l")), [("# a",), ("",), ("a",), (" # a",)], "l") == [False, False, True, True]


def test_blamed_crate(values):
    rows = [
        ("error: no matching package named `foo` found",),
        ("package `bar` depends on `foo` with feature `x` but …",),
        ('failed to select a version for the requirement `foo = "*"`',),
        ("error: failed to select a version for `foo`.",),
        ("error: something else",),
        ("depends on `a` with feature x; depends on `b` with feature y",),
    ]
    assert values(N.blamed_crate(c("l")), rows, "l") == ["foo", "foo", "foo", "foo", None, "b"]


def test_lines_and_gaps(values):
    assert values(N.split_lines(c("t")), [("a\nb\n",), ("a\n\n",), ("a",)], "t") == [["a", "b"], ["a", ""], ["a"]]
    assert values(N.clean_gap_line(c("t")), [("[WARN fixups] x fixups] y",), ("plain",)], "t") == ["  y", "plain"]
    assert values(N.is_error_line(c("t")), [("ERROR: a",), ("an eRRor",), ("fine",)], "t") == [True, True, False]


def test_version_key_orders_by_component(values):
    rows = [("1.0.9",), ("1.0.27",), ("1.20",), ("1.20.0",), ("2.0.0-beta1",), ("1.2.3+m.4",), ("*",)]
    keys = values(V.version_key(c("v")), rows, "v")
    assert keys[0] < keys[1] < keys[2] == keys[3] == [1, 20, 0]
    assert keys[4] == [2, 0, 0] and keys[5] == [1, 2, 3]
    assert values(V.is_prerelease(c("v")), rows, "v") == [False, False, False, False, True, False, False]


def test_parse_version_gate(values):
    gates = [
        ('cfg(version = ">=1.0.0, <1.20.0")',),
        ('cfg(version = ">=1.0.228")',),
        ('cfg(all(version = "=0.17.14", target_arch = "x86_64"))',),
        ('cfg(version = "<2")',),
        ('cfg(target_os = "linux")',),
        (None,),
    ]
    got = values(V.parse_version_gate(c("g")), gates, "g")
    plain = [g and (g["lo"], g["hi"], g["hi_inc"], g["exact"], g["version_only"]) for g in got]
    assert plain == [
        ([1, 0, 0], [1, 20, 0], False, False, True),
        ([1, 0, 228], None, False, False, True),
        ([0, 17, 14], [0, 17, 14], True, True, False),
        (None, [2, 0, 0], False, False, True),
        None,
        None,
    ]


def test_gates_that_are_no_simple_version_test(values):
    bad = ['cfg(version = "<=1.2")', 'cfg(version = ">1.0")', 'cfg(version = "1.2")', 'cfg(not(target_os = "linux"))', "cfg(unix)",
           'cfg(any(version = ">=1", version = "<2"))', 'cfg(target_family = "unix")']
    good = [None, 'cfg(version = ">=1, <2.5")', 'cfg(all(version = "=1.2", any(target_os = "linux", target_env = "")))', 'cfg(version = "<3")']
    assert values(V.is_read(c("g")), [(g,) for g in bad + good], "g") == [False] * len(bad) + [True] * len(good)
    bounds = V.parse_version_gate(c("g"))
    inside = V.within(V.version_key(F.lit("1.2.0")), bounds["lo"], bounds["hi"], bounds["hi_inc"])
    assert values(inside, [(g,) for g in bad[:3]], "g") == [False] * 3

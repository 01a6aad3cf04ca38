"""Fixed values.

These must equal the formats of the audited collections for the results to be
right, so they are stated here, as they are, and nowhere else.
"""

# Labels: ``<cell>//<package path>:<name>[-<version>][#config]``.
LABEL_CELL = "fixups"
VERSION_SUFFIX = r"-[0-9][0-9.]*$"

# Sweep reports, logs and known-failure lists.
SUCCESS = "SUCCESS"
CANCEL_TEXT = "evaluation of this key was cancelled"
KNOWN_FAILURE_FILE = r"expected-failures-([^/]*)\.txt$"
KNOWN_FAILURE_GLOB = "expected-failures-*.txt"

# Platform keys.
WINDOWS_OS = r"^(MINGW|MSYS|CYGWIN)"
RUNNER_ARCH = {"ARM64": "aarch64", "X64": "x86_64"}

# Platforms of known-failure lists, and what dependencies that hold on one platform call them.
PLATFORMS = {
    "Darwin-arm64": ("macos-arm64",),
    "Linux-aarch64": ("linux-arm64",),
    "Linux-x86_64": ("linux-x86_64",),
    "Windows-x86_64": ("windows-msvc",),
}

# Changed paths.
SHARED_FIXUP_PATH = r"^fixups/([^/]*)/.*"
RIG_FIXUP_PATH = r"^third-party/conflict-rigs/[^/]*/fixups/([^/]*)/.*"
RIG_OF_FIXUP_PATH = r"^(third-party/conflict-rigs/[^/]*)/fixups/.*"

# Rigs and the files in them.
MAIN_RIG = "third-party"
SNAPSHOT_RIG = r"^third-party/snapshots/([^/]+)$"
# What a change can hit: the main rig and the conflict rigs. Dated snapshots are left to the sweep.
IMPACT_PATTERNS = ("//third-party:", "//third-party/conflict-rigs/...")
SUB_RIG_MANIFEST = r"^(third-party/(?:conflict-rigs|snapshots)/[^/]+)/Cargo\.toml$"
MANIFEST_FILE = "Cargo.toml"
LOCK_FILE = "Cargo.lock"
DIRECTIVE_FILE = "fixups.toml"
TARGET_FILE = "BUCK"
# Names the native library a package claims.
LINKS_VARIABLE = "CARGO_MANIFEST_LINKS"

# Kinds built by a sweep, and kinds a change can hit.
SWEEP_KINDS = ("alias",)
IMPACT_KINDS = ("alias", "rust_library")
KIND_PREFIX = "cargo."

# Crates pinned to one exact version; they are never floated.
EXACT_PINNED = ("ring", "matchit_v8")

# Resolver messages; the first group is the crate to blame. Greedy, so the last
# occurrence in a line counts; the first pattern that matches a line wins.
BLAME_PATTERNS = (
    r"^.*no matching package named `([^`]*)`",
    r"^.*depends on `([^`]*)` with feature",
    r"^.*failed to select a version for the requirement `([^ ]*) ",
    r"^.*failed to select a version for `([^`]*)`",
)

# Index and generator output.
INDEX_HOST = "crates.io"
GAP_PREFIX = r"^.*fixups\] "

# Lines shown of a failure.
DIFF_LINES = 20
ERROR_LINES = 8
TAIL_LINES = 20

"""Build outcomes, platform keys and index expectations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import INDEX_HOST, RUNNER_ARCH, SUCCESS, WINDOWS_OS


def not_success(success: Column, ok: str = SUCCESS) -> Column:
    """Anything but ``ok`` failed; a missing outcome failed too."""
    return ~success.eqNullSafe(ok)


def platform_key(os: Column, arch: Column, runner_arch: Column) -> Column:
    """``<os>-<arch>``; on Windows shells the runner knows the true architecture."""
    is_windows = os.rlike(WINDOWS_OS) | (os == "Windows")
    true_arch = arch
    for runner, name in RUNNER_ARCH.items():
        true_arch = F.when(is_windows & (runner_arch == runner), F.lit(name)).otherwise(true_arch)
    return F.concat_ws("-", F.when(is_windows, F.lit("Windows")).otherwise(os), true_arch)


def index_is_faithful(config: Column, host: str = INDEX_HOST) -> Column:
    """An index is faithful when the ``dl`` address in its JSON names ``host``."""
    return F.coalesce(F.get_json_object(config, "$.dl"), F.lit("")).contains(host)

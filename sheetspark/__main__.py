"""``python -m sheetspark SETTINGS.yaml [-o REPORT.txt] [--views FOLDER] [--log LEVEL]``: resistance, power and currents
from files, and with ``--views`` the colour maps and grids of the solved run."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from . import log


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sheetspark")
    p.add_argument("settings", help="settings document; relative paths in it start at project.cci_dir, else at its folder")
    p.add_argument("-o", "--output", help="file of the report; standard output without it")
    p.add_argument("--views", help="folder of colour maps and grids of the solved run; none without it")
    p.add_argument("--out-dbu-nm", type=float, default=1.0, help="database unit of the colour maps in nanometres")
    p.add_argument("--z-scale", type=float, default=25.0, help="by how much the stack's heights are stretched")
    p.add_argument("--bins", type=int, default=32, help="colours of a map")
    p.add_argument("--log", default="info", choices=["off", "error", "warning", "info", "debug"])
    given = p.parse_args(argv)
    log.configure(given.log)
    from .plans import files, views
    from .sources.config import settings

    with open(given.settings, encoding="utf-8") as f:
        document = f.read()
    root = settings(document).paths.get("cci_dir") or os.path.dirname(os.path.abspath(given.settings))
    result = files.run(SparkSession.builder.appName("sheetspark").getOrCreate(), document, root)
    if given.output:
        with open(given.output, "w", encoding="utf-8") as f:
            f.write(result.text)
    else:
        print(result.text, end="")
    if given.views:
        views.write_views(result.field, given.views, given.out_dbu_nm * 1e-9, given.z_scale, given.bins)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m meshspark box|convert|check|partition|surface ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import tools
from .schema import MeshError


def main(words: list[str]) -> int:
    top = argparse.ArgumentParser(prog="meshspark", description=__doc__)
    sub = top.add_subparsers(dest="tool", required=True)
    p = sub.add_parser("box", help="x0 x1 y0 y1 z0 z1 nx ny nz [px py pz] [fx fy fz] [out.nmsh] [--direct]")
    p.add_argument("words", nargs=argparse.REMAINDER)
    p = sub.add_parser("convert", help="a re2 file to a mesh file")
    p.add_argument("mesh")
    p.add_argument("out", nargs="?")
    p = sub.add_parser("check", help="validate a mesh and report its sizes, zones and quality")
    p.add_argument("mesh")
    p.add_argument("--jacobian", action="store_true")
    p.add_argument("--write-zone-indices", action="store_true")
    p = sub.add_parser("partition", help="write a mesh whose linear read is a partition")
    p.add_argument("mesh")
    p.add_argument("nparts", type=int)
    p.add_argument("out", nargs="?")
    p.add_argument("--backend", choices=("spectral", "metis", "geometric"), default="spectral")
    p.add_argument("--metis", dest="backend", action="store_const", const="metis")
    p.add_argument("--geometric", dest="backend", action="store_const", const="geometric")
    p.add_argument("--no-stats", action="store_true")
    p = sub.add_parser("surface", help="write the external surface as a VTK file")
    p.add_argument("mesh")
    p.add_argument("out")
    p.add_argument("--color", choices=("zone", "partition", "jacobian"), default="zone")
    p.add_argument("--nparts", type=int, default=0)
    told = top.parse_args(words)
    spark = SparkSession.builder.appName("meshspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if told.tool == "box":
            print("wrote", tools.make_box(spark, told.words))
        elif told.tool == "convert":
            print("wrote", tools.convert(spark, told.mesh, told.out))
        elif told.tool == "check":
            got, sound = tools.check(spark, told.mesh, told.jacobian, told.write_zone_indices)
            for r in got.collect():
                print(f"{r.metric:12} {r.value:.6g}")
            return 0 if sound else 1
        elif told.tool == "partition":
            out, cut = tools.prepare_partition(spark, told.mesh, told.nparts, told.out, told.backend, not told.no_stats)
            if cut is not None:
                r = cut.first()
                print(f"cut {r.cut:.0f} of {r.total:.0f} links ({100 * r.cut / max(r.total, 1):.3f} %)")
            print("wrote", out)
        else:
            print("wrote", tools.export_surface(spark, told.mesh, told.out, told.color, told.nparts))
    except MeshError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

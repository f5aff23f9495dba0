"""Telling scanned pages from photographs by their tags and sizes, and the join of sizes within a tolerance that it needs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# makers' words for scanners and their programs, editors, resolutions that scanners offer, and sheets in inches; of several that fit the first counts.
DEVICES = (
    "scan", "lide", "perfection", "documate", "workcentre", "imageclass", "imagerunner", "pixma", "officejet", "deskjet", "envy photo", "mfc-", "dcp-", "ads-", "fi-", "ix500", "ix1400",
    "ix1500", "ix1600", "s1300", "sv600", "kv-s", "ds-510", "ds-530", "ds-570", "epson stylus", "smartsource",
)
SOFTWARE = (
    "epson scan", "epsonscan", "vuescan", "naps2", "silverfast", "scangear", "captureperfect", "captureontouch", "paperport", "readiris", "abbyy", "finereader", "hp solution", "hp smart", "hp scan",
    "image capture", "windows fax and scan", "simple scan", "xsane", "scanbot", "genius scan", "scanner pro", "docscan", "camscanner", "turboscan", "scansnap",
)
EDITORS = (
    "photoshop", "gimp", "lightroom", "affinity", "illustrator", "indesign", "capture one", "luminar", "pixelmator", "paint.net", "krita", "clip studio", "paint tool sai", "procreate", "blender",
    "imagemagick", "ffmpeg", "canva", "figma", "sketch", "inkscape", "picasa", "irfanview",
)
SCAN_DPI = (100, 120, 150, 200, 240, 300, 360, 400, 600, 720, 800, 1200, 1600, 2400, 3200, 4800, 9600)
PAGES = (
    ("A3", 11.693, 16.535), ("A4", 8.268, 11.693), ("A5", 5.827, 8.268), ("A6", 4.134, 5.827), ("B4", 9.843, 13.898), ("B5", 6.929, 9.843), ("Letter", 8.5, 11.0), ("Legal", 8.5, 14.0),
    ("Tabloid", 11.0, 17.0), ("Executive", 7.25, 10.5), ("Folio", 8.5, 13.0),
)
PRINTS = (
    ("3.5x5", 3.5, 5.0), ("4x6", 4.0, 6.0), ("5x7", 5.0, 7.0), ("6x8", 6.0, 8.0), ("8x10", 8.0, 10.0), ("8x12", 8.0, 12.0), ("2.5x3.5", 2.5, 3.5), ("6x6", 6.0, 6.0), ("3.5x3.5", 3.5, 3.5),
)
TOLERANCE = 0.12
EXPOSURE = ("exposure_time", "aperture", "iso", "focal_length", "lens")


def near_join(left: DataFrame, right: DataFrame, on: dict[str, str], tolerance: float) -> DataFrame:
    """Pairs of rows whose columns (left: right) differ by ``tolerance`` at most.

    Numbers are dealt to cells twice as wide as the tolerance. A right row stands in its own cell and the ones beside it, so equal cells
    meet all that are near, once each; it is an equality join of any size. Rows with a null among these columns meet none.
    """
    width = 2 * tolerance
    cells = {f"_cell{k}": (a, b) for k, (a, b) in enumerate(on.items())}
    placed = left.withColumns({c: F.floor(F.col(a) / width) for c, (a, _) in cells.items()})
    spread = right
    for c, (_, b) in cells.items():
        middle = F.floor(F.col(b) / width)
        spread = spread.withColumn(c, F.explode(F.sequence(middle - 1, middle + 1)))
    near = reduce(Column.__and__, [F.abs(F.col(a) - F.col(b)) <= tolerance for a, b in on.items()])
    return placed.join(spread, list(cells)).where(near).drop(*cells)


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(map(re.escape, words))), F.lit(False))


def resolution(horizontal: Column, vertical: Column, unit: Column) -> Column:
    """The one resolution in dots an inch, if a scanner offers it: axes that differ and tags without a unit say nothing."""
    square = ~((vertical > 0) & (F.abs(horizontal - vertical) > 0.5))
    dots = F.when(unit == 3, horizontal * 2.54).when(unit.isNull() | (unit == 2), horizontal)
    dpi = F.bround(F.when((horizontal > 0) & F.coalesce(square, F.lit(True)), dots), 0).cast("int")
    return F.get(F.filter(F.array(dpi), lambda d: d.isin(*SCAN_DPI)), F.lit(0))


def detect_scans(images: DataFrame, id_col: str) -> DataFrame:
    """(id, scan_of, paper, dpi, evidence) of the images that are scans; ``evidence`` is "exif" where the tags name a scanner, else "dimensions".

    ``images``: width, height, x_resolution, y_resolution, resolution_unit, make, model, software and the tags of EXPOSURE, any of which says that a camera took it. An image of the size of a
    sheet at a scanner's resolution is a page, unless an editor made it and no scanner is named; sizes of prints only count with a scanner named.
    Each row is judged on its own; equal sizes are compared with the sheets once.
    """
    camera = reduce(Column.__or__, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in EXPOSURE])
    named = _mentions(F.col("make"), DEVICES) | _mentions(F.col("model"), DEVICES) | _mentions(F.col("software"), SOFTWARE)
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    dpi = F.when(sized, resolution(F.col("x_resolution"), F.col("y_resolution"), F.col("resolution_unit")))
    told = F.struct(F.col(id_col).alias("id"), "width", "height", named.alias("named"), _mentions(F.col("software"), EDITORS).alias("edited"), dpi.alias("dpi"))
    seen = images.where(~camera).select(F.inline(F.array(told)))  # each is computed once, whatever uses it
    seen = seen.where("named or dpi is not null").withColumns({"short": F.least("width", "height") / F.col("dpi"), "long": F.greatest("width", "height") / F.col("dpi")})
    rows = [("page", k, *sheet) for k, sheet in enumerate(PAGES)] + [("print", k, *sheet) for k, sheet in enumerate(PRINTS)]
    literal = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("place"), F.lit(name).alias("sheet"), F.lit(a).alias("_a"), F.lit(b).alias("_b")) for kind, k, name, a, b in rows])
    sheets = images.sparkSession.range(1).select(F.inline(literal))
    sizes = seen.where("short is not null").select("short", "long").distinct()
    fit = near_join(sizes, F.broadcast(sheets), {"short": "_a", "long": "_b"}, TOLERANCE)  # twenty sheets
    first = fit.groupBy("short", "long").agg(F.min(F.when(F.col("kind") == "page", F.struct("place", "sheet"))).alias("_page"), F.min(F.when(F.col("kind") == "print", F.struct("place", "sheet"))).alias("_print"))
    told = seen.join(first, ["short", "long"], "left")
    page = F.when(~(F.col("edited") & ~F.col("named")), F.col("_page.sheet"))
    found = told.withColumn("_sheet", page).where("_sheet is not null or named")
    print_ = F.when(F.col("_sheet").isNull(), F.col("_print.sheet"))
    return found.select("id", F.when(print_.isNotNull(), "print").otherwise("page").alias("scan_of"), F.coalesce("_sheet", print_).alias("paper"), "dpi", F.when(F.col("named"), "exif").otherwise("dimensions").alias("evidence"))

"""Kinds and formats of binary content by its first bytes, as JVM expressions over a BINARY column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.derive import CERTAIN, STRONG

# Offset, magic bytes in hexadecimal, kind, format; the first that fits is the answer.
SIGNATURES = (
    (0, "89504E470D0A1A0A", "image", "png"), (0, "FFD8FF", "image", "jpeg"), (0, "474946383761", "image", "gif"), (0, "474946383961", "image", "gif"), (0, "424D", "image", "bmp"),
    (0, "00000100", "image", "icon"), (0, "38425053", "image", "psd"), (0, "49492A00", "image", "tiff"), (0, "4D4D002A", "image", "tiff"), (0, "762F3101", "image", "openexr"),
    (0, "664C6143", "audio", "flac"), (0, "494433", "audio", "mp3"), (0, "FFFB", "audio", "mp3"), (0, "4D546864", "audio", "midi"), (0, "52463634", "audio", "wav"),
    (0, "25504446", "document", "pdf"), (0, "7B5C727466", "document", "rtf"), (0, "D0CF11E0A1B11AE1", "document", "ole2"),
    (0, "1F8B", "archive", "gzip"), (0, "425A68", "archive", "bzip2"), (0, "FD377A585A00", "archive", "xz"), (0, "28B52FFD", "archive", "zstd"), (0, "377ABCAF271C", "archive", "7z"),
    (0, "526172211A07", "archive", "rar"), (257, "7573746172", "archive", "tar"), (0, "7F454C46", "app", "linux-executable"), (0, "4D5A", "app", "windows-executable"),
    (0, "53514C69746520666F726D6174203300", "data", "sqlite"), (0, "50415231", "data", "columnar"), (0, "4F626A01", "data", "columnar"), (0, "894844460D0A1A0A", "data", "hdf"),
    (0, "4F54544F", "font", "opentype"), (0, "774F4646", "font", "woff"), (0, "774F4632", "font", "woff2"), (0, "0001000000", "font", "truetype"), (0, "676C5446", "model3d", "gltf"),
)
#: Formats whose magic is so short that it turns up by chance.
SHORT = ("bmp", "mp3", "gzip", "windows-executable", "linux-executable", "icon", "truetype")
# Brands of ISO media files; the rest are mp4.
BRANDS = {"heic": ("image", "heif"), "heix": ("image", "heif"), "mif1": ("image", "heif"), "avif": ("image", "avif"), "qt  ": ("video", "quicktime"), "M4A ": ("audio", "m4a"), "M4B ": ("audio", "m4a"), "3gp4": ("video", "3gpp"), "3gp5": ("video", "3gpp"), "crx ": ("image", "raw")}
RIFF = {"WAVE": ("audio", "wav"), "AVI ": ("video", "avi"), "WEBP": ("image", "webp")}
OFFICE = {"word/": "docx", "xl/": "xlsx", "ppt/": "pptx"}


def _bytes(content: Column, offset: int, n: int) -> Column:
    return F.hex(F.substring(content, offset + 1, n))


def _text(content: Column, offset: int, n: int) -> Column:
    return F.decode(F.substring(content, offset + 1, n), "ISO-8859-1")


def _answer(kind: str, fmt: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(fmt).alias("format"), F.lit(STRONG if fmt in SHORT else CERTAIN).alias("confidence"))


def sniff(content: Column) -> Column:
    """struct(kind, format, confidence) from the content's bytes; null where nothing fits. Only its first kilobytes are looked at."""
    head = F.substring(content, 1, 8192)
    found: list[Column] = []
    brand = _text(head, 8, 4)
    iso = _bytes(head, 4, 4) == "66747970"
    found += [F.when(iso & (brand == b), _answer(*a)) for b, a in BRANDS.items()] + [F.when(iso, _answer("video", "mp4"))]
    riff = _bytes(head, 0, 4) == "52494646"
    found += [F.when(riff & (brand == b), _answer(*a)) for b, a in RIFF.items()]
    ebml = _bytes(head, 0, 4) == "1A45DFA3"
    found += [F.when(ebml & _text(head, 0, 64).contains("webm"), _answer("video", "webm")), F.when(ebml, _answer("video", "matroska"))]
    ogg = _bytes(head, 0, 4) == "4F676753"
    found += [F.when(ogg & _text(head, 0, 64).contains("theora"), _answer("video", "ogg-video")), F.when(ogg, _answer("audio", "ogg"))]
    zipped, listing = _bytes(head, 0, 4) == "504B0304", _text(head, 0, 8192)
    found += [F.when(zipped & listing.contains(part), _answer("document", fmt)) for part, fmt in OFFICE.items()]
    found += [F.when(zipped & listing.contains("application/epub+zip"), _answer("document", "epub")), F.when(zipped & listing.contains("application/vnd.oasis.opendocument.text"), _answer("document", "odt")), F.when(zipped, _answer("archive", "zip"))]
    found += [F.when(_bytes(head, offset, len(magic) // 2) == magic, _answer(kind, fmt)) for offset, magic, kind, fmt in SIGNATURES]
    return F.coalesce(*found)


def png_size(content: Column) -> Column:
    """struct(width, height, alpha) of a PNG header, null for anything else."""
    number = lambda at: F.conv(_bytes(content, at, 4), 16, 10).try_cast("int")
    alpha = _bytes(content, 25, 1).isin("04", "06")
    return F.when(_bytes(content, 0, 8) == "89504E470D0A1A0A", F.struct(number(16).alias("width"), number(20).alias("height"), alpha.alias("alpha")))

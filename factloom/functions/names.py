"""Facts that a file's name holds: dates, capture tools, copies, sequences, litter, subtitles, versions.

Each detector is an expression over the stem (and extension); none sees another's
result but through its arguments, so all of them are one projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.derive import CERTAIN, LIKELY, STRONG, WEAK
from factloom.functions.language import bind

# Month names of several languages, by number.
MONTHS = {
    1: "jan january januar janvier enero", 2: "feb february februar fevrier février febrero", 3: "mar march märz maerz mars marzo", 4: "apr april avril abril", 5: "may mai mayo", 6: "jun june juni juin junio",
    7: "jul july juli juillet julio", 8: "aug august aout août agosto", 9: "sep sept september septembre septiembre", 10: "oct october oktober octobre octubre", 11: "nov november novembre noviembre", 12: "dec december dezember decembre décembre diciembre",
}
#: What may stand between the numbers of a date, and between a month's name and its day or year.
NUMBER_GAPS, WORD_GAP = ("-", "_", "."), r"^[.,]?\s+$"


def plain(stem: Column) -> Column:
    return F.replace(stem, F.lit("_"), F.lit(" "))


def _month_of(word: Column) -> Column:
    named = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in names.split() for x in (name, n)])
    return F.element_at(named, F.lower(word))


def _date_at(tokens: Column, i: Column) -> Column:
    """The date that begins at token i as struct(form, at, text), null where none does.

    Year first may stand in one run of digits or in several. With the year last, the number
    beyond 12 is the day, and without one the order is in doubt and there is no date.
    """
    token = lambda k: F.coalesce(F.get(tokens, i + k), F.lit(""))
    digits = lambda k: F.when(token(k).rlike(r"^\d+$"), F.char_length(token(k))).otherwise(0)
    number = lambda c: c.try_cast("int")
    near, next_near = token(1).isin(*NUMBER_GAPS), token(3).isin(*NUMBER_GAPS)
    spaced = token(1).rlike(WORD_GAP) & token(3).rlike(WORD_GAP)

    run = (
        F.when(digits(0) == 8, token(0))
        .when((digits(0) == 4) & near & (digits(2) == 2) & next_near & (digits(4) == 2), F.concat(token(0), token(2), token(4)))
        .when(digits(0).isin(4, 6) & near & (digits(0) + digits(2) == 8), F.concat(token(0), token(2)))
    )
    year_first = (F.left(run, F.lit(4)), F.substring(run, 5, 2), F.substring(run, 7, 2))
    last = near & next_near & (digits(0) == 2) & (digits(2) == 2) & (digits(4) == 4)
    day_first = number(token(0)) > 12
    sure = last & (day_first | (number(token(2)) > 12))
    year_last = [F.when(sure, c) for c in (token(4), F.when(day_first, token(2)).otherwise(token(0)), F.when(day_first, token(0)).otherwise(token(2)))]
    word_first = [F.when(spaced & digits(2).between(1, 2) & (digits(4) == 4), c) for c in (token(4), _month_of(token(0)).cast("string"), token(2))]
    word_second = [F.when(spaced & digits(0).between(1, 2) & (digits(4) == 4), c) for c in (token(4), _month_of(token(2)).cast("string"), token(0))]

    def read(form: int, parts) -> Column:
        y, m, d = map(number, parts)
        text = F.format_string("%04d-%02d-%02d", y, m, d)
        return F.when(y.between(1900, 2099) & m.between(1, 12) & d.between(1, 31), F.struct(F.lit(form).alias("form"), i.alias("at"), text.alias("text")))

    return F.coalesce(*[read(k, parts) for k, parts in enumerate((year_first, year_last, word_first, word_second))])


def name_date(stem: Column) -> Column:
    """struct(value, confidence) of the surest, then first date in a name, else of an epoch time in seconds or milliseconds; null without one."""
    pieces = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+|\p{L}+|[^\d\p{L}]+)"), F.lit(1))

    def of(tokens: Column) -> Column:
        places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
        date = F.array_min(F.filter(F.transform(places, lambda i: _date_at(tokens, i)), lambda x: x.isNotNull()))["text"]
        seconds = F.filter(tokens, lambda t: t.rlike(r"^\d+$") & F.char_length(t).isin(10, 13))
        seconds = F.filter(F.transform(seconds, lambda t: F.left(t, F.lit(10)).try_cast("long")), lambda n: (n > 1_000_000_000) & (n < 2_000_000_000))
        moment = F.left(F.timestamp_seconds(F.get(seconds, F.lit(0))).cast("string"), F.lit(10))
        made = lambda text, confidence: F.when(text.isNotNull(), F.struct(text.alias("value"), F.lit(confidence).alias("confidence")))
        return F.coalesce(made(date, LIKELY), made(moment, WEAK))

    return bind(pieces(stem), of)


# Words by which programs name what they take of a screen, with single blanks between words.
SHOT_WORDS = (
    "screenshot", "screen shot", "screen capture", "screencapture", "scrn", "scr", "bildschirmfoto", "capture d'écran", "capture d’écran", "capture d'ecran", "capture décran", "captura de pantalla",
    "schermafbeelding", "skärmavbild", "skærmbillede", "skjermbilde", "kuvakaappaus", "zrzut ekranu", "снимок экрана", "スクリーンショット", "螢幕截圖", "屏幕截图", "cleanshot", "shottr",
)
RECORDING_WORDS = ("screen recording", "screenrecording", "bildschirmaufnahme", "screencast", "screen record", "screenrecord")


def _begins_with(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text begins with one of the words, and not with a longer one."""
    return text.rlike("^(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")(?![a-z])")


def capture(stem: Column) -> Column:
    text = F.lower(F.regexp_replace(F.ltrim(stem), "[ _-]+", " "))
    return F.when(_begins_with(text, RECORDING_WORDS), "screen-recording").when(_begins_with(text, SHOT_WORDS), "screenshot")


# What systems leave behind; names that say nothing; sizes, versions and copies as words.
OS_LITTER = (
    ".ds_store", "thumbs.db", "desktop.ini", "icon\r", ".localized", "__macosx", ".spotlight-v100", ".trashes", ".fseventsd", "$recycle.bin", "system volume information", ".apdisk", "ehthumbs.db",
)
GENERIC_NAMES = (
    "untitled", "unnamed", "new file", "new document", "new folder", "new image", "new text document", "document", "image", "photo", "picture", "video", "audio", "file", "download", "downloaded",
    "output", "export", "final", "draft", "temp", "tmp", "test", "asdf", "aaa", "blob", "index", "sample",
)
SIZE_WORDS = ("thumb", "thumbnail", "small", "medium", "large", "min", "preview", "@2x", "@3x", "scaled", "cropped")
VERSION_WORDS = ("final", "FINAL", "draft", "wip", "rev", "revision", "old", "backup", "bak", "orig", "original", "new", "latest", "update", "updated")
COPY_STARTS, COPY_WORDS = ("copy of", "copia de", "kopie von"), ("copy", "kopie", "kopia", "copia")
#: Hexadecimal digits of the usual digests, and the groups of a UUID.
DIGEST_DIGITS, UUID_GROUPS = (32, 40, 64), (8, 4, 4, 4, 12)


def is_generic(stem: Column) -> Column:
    """Whether a name is one that says nothing, with a counter of up to three digits behind it or none."""
    return F.regexp_replace(F.lower(stem), r"[ _-]?\d{0,3}$", "").isin(*GENERIC_NAMES)


def is_hash(stem: Column) -> Column:
    groups = F.transform(F.split(stem, "-"), F.char_length)
    lengths = (groups == F.array(*map(F.lit, UUID_GROUPS))) | ((F.size(groups) == 1) & F.char_length(stem).isin(*DIGEST_DIGITS))
    return stem.rlike("^[0-9A-Fa-f-]+$") & lengths


def is_web_sized(stem: Column) -> Column:
    """Whether a part of the name between - or _ is a size: two numbers of two to four digits with an x, or a word."""
    return F.exists(F.split(F.lower(stem), "[-_]"), lambda x: x.isin(*SIZE_WORDS) | x.rlike(r"^\d{2,4}x\d{2,4}$"))


def version_marker(stem: Column) -> Column:
    """The first word that tells a version, lower-cased: one of the list, or v, rev or version with a number."""
    joined = F.regexp_replace(stem, r"\bversion\s(?=\d)", "version")
    words = F.filter(F.split(joined, r"\W+"), lambda w: w.isin(*VERSION_WORDS) | w.rlike(r"^(v|rev|version)\d+$"))
    return F.lower(F.get(words, F.lit(0)))


def is_litter(name: Column) -> Column:
    return F.lower(name).isin(*OS_LITTER) | name.startswith("._")


def copy_marker(stem: Column) -> Column:
    """"copy of" before a name, or what marks it as a copy behind it: a number in brackets, or a word with a number or none."""
    words = "|".join(COPY_WORDS)
    tail = F.trim(F.regexp_extract(stem, rf"(?i)(\(\d{{1,2}}\)|[ _-](?:{words})|[ _-](?:{words})[ _-]\d{{1,2}})$", 1))
    return F.when(_begins_with(F.lower(stem), COPY_STARTS), "copy of").when((tail != "") & (stem != tail), tail)


# How cameras and phones begin the names they count.
CAMERA_PREFIXES = ("IMG", "DSC", "DSCN", "DSCF", "MVI", "PXL", "VID", "GOPR", "GX", "GH", "SAM", "PANO")


def camera_series(stem: Column) -> Column:
    """The prefix of a name that a camera has counted: letters, a separator or none, three digits or more."""
    letters = F.upper(F.regexp_extract(stem, r"^([A-Za-z]+)[_-]?\d{3}", 1))
    return F.when(letters.isin(*CAMERA_PREFIXES), letters)


def sequence(stem: Column) -> Column:
    """struct(prefix, number) of a zero-padded counter of three digits or more at the end; a year is none."""
    number = F.regexp_extract(stem, r"^(.*?)(\d{2,5})$", 2)
    prefix = F.regexp_replace(F.regexp_extract(stem, r"^(.*?)(\d{2,5})$", 1), r"[-_. ]+$", "")
    return F.when((prefix != "") & (F.char_length(number) >= 3) & number.startswith("0"), F.struct(prefix.alias("prefix"), number.try_cast("int").alias("number")))


SUBTITLE_FORMATS = ("srt", "vtt", "ass", "ssa", "sub", "sup", "smi", "idx", "ttml")
SUBTITLE_FLAGS = r"(forced|sdh|cc|hi|default)"


def subtitle(stem: Column, ext: Column) -> Column:
    """struct(language, belongs_to, flags) of a subtitle's name; flags behind and before the language are passed over."""
    bare = F.regexp_replace(stem, rf"(?i)(\.{SUBTITLE_FLAGS})+$", "")
    language = F.lower(F.regexp_extract(bare, r"\.([A-Za-z]{2,3}(?:-[A-Za-z]{2,4})?)$", 1))
    flags = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(stem, F.lit(rf"(?i)\.{SUBTITLE_FLAGS}(?=\.|$)"), F.lit(1)), F.lower)))
    named = F.struct(F.nullif(language, F.lit("")).alias("language"), F.when(language != "", F.regexp_replace(bare, r"\.[^.]+$", "")).alias("belongs_to"), flags.alias("flags"))
    return F.when(F.lower(ext).isin(*SUBTITLE_FORMATS), named)


def name_facts(name: Column) -> list[Column]:
    """The columns of all detectors for a file name."""
    ext = F.regexp_extract(name, r"^.+\.([A-Za-z0-9]{1,10})$", 1)
    stem = F.when(ext != "", F.regexp_replace(name, r"\.[A-Za-z0-9]{1,10}$", "")).otherwise(name)
    date, sub, camera = name_date(plain(stem)), subtitle(stem, ext), camera_series(stem)
    seq = F.when(camera.isNull() & capture(stem).isNull() & sub["language"].isNull(), sequence(stem))
    litter = is_litter(name)
    return [
        stem.alias("stem"), F.lower(ext).alias("ext"), date["value"].alias("name_date"), date["confidence"].alias("name_date_confidence"), capture(stem).alias("capture"), camera.alias("camera_series"),
        litter.alias("litter"), is_generic(stem).alias("generic_name"), is_hash(stem).alias("hash_name"), copy_marker(stem).alias("copy_marker"), is_web_sized(stem).alias("web_sized"),
        version_marker(stem).alias("version_marker"), (stem.contains("%20") | F.upper(stem).contains("%2F")).alias("url_encoded"), seq["prefix"].alias("sequence_prefix"), seq["number"].alias("sequence_number"),
        sub["language"].alias("subtitle_language"), sub["belongs_to"].alias("subtitle_for"),
        F.when(litter, "os-litter").when(capture(stem).isNotNull(), capture(stem)).when(is_hash(stem), "hash-name").when(is_generic(stem), "generic-name").alias("looks_like"),
        F.when(litter, CERTAIN).when(capture(stem).isNotNull(), STRONG).when(is_hash(stem) | is_generic(stem), LIKELY).alias("looks_like_confidence"),
    ]

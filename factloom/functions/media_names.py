"""Facts that names of media and programs hold: messaging exports, scanners' names, installers, samples, music, releases.

Each detector is one expression over a stem and gives a struct of what it found, null where it finds nothing. Word lists and
the shapes of names are fixed values; what is read from them is written in column functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.language import bind

# How programs begin the names of what they save, in the order they are tried; some say nothing of the program.
MESSAGING = (
    (r"(IMG|VID|AUD|PTT|DOC|STK)-\d{8}-WA\d{4}", "WhatsApp"), (r"WhatsApp (Image|Video|Audio|Document|Animated Gif)", "WhatsApp"), (r"Signal[-_ ]", "Signal"),
    (r"(photo|video|audio|file|voice)_\d{4}-\d{2}-\d{2}_", "Telegram"), (r"FB_IMG_\d+", "Facebook"), (r"received_\d{10,}", "Facebook Messenger"), (r"Snapchat-\d+", "Snapchat"),
    (r"(instagram|insta)[-_]", "Instagram"), (r"InShot_\d+", "InShot"), (r"(tiktok|douyin)[-_]", "TikTok"), (r"Viber[-_ ]image", "Viber"), (r"SPIcon|IMG_\d{4}_iOS", None),
)
SCANNERS = (
    (r"scan[_ -]?\d*", None), (r"scanned[ _-]", None), (r"CamScanner", "CamScanner"), (r"Adobe Scan", "Adobe Scan"), (r"(NEW )?DOC[-_ ]?\d", None), (r"SKM[_ ]?C\d", "Konica Minolta"),
    (r"EPSON\d*", "Epson"), (r"img\d{8}_\d{4}$", None), (r"Document[ _-]?\d", None), (r"(Notes|Note)[ _-]?\d{1,2}[-_ ]", None),
)
INSTALLER = r"(?i)\b(setup|install(?:er|ation)?|portable|x64|x86|amd64|arm64|aarch64|win(?:dows)?(?:32|64)?|macos|darwin|linux|universal|full|offline)\b"
VERSION = r"(?i)(?<![\w.])v?(\d{1,3}(?:\.\d{1,4}){1,3})(?:[-_]?(alpha|beta|rc\d*|dev|nightly|esr|lts|stable|preview))?(?!\d)(?!\.\d)"
INSTALLED_KINDS = ("app", "disk-image")
SAMPLE_WORDS = (
    r"(?i)\b(kick|snare|hat|hi-?hat|clap|rim|tom|crash|ride|perc|shaker|cowbell|808|909|707|clave|loop|oneshot|one[-_ ]shot|stab|riser|downlifter|uplifter|impact|whoosh|sweep|fx|foley|vox|acapella|"
    r"bassline|arp|pluck|pad|lead|sub|drone|texture)\b"
)
TEMPO = r"(?i)(?<!\d)(\d{2,3})\s*_?bpm\b|(?<!\w)bpm[ _]?(\d{2,3})"
MUSICAL_KEY = r"(?<![a-z])([A-G](?:#|b)?)[ _-]?(maj|min|m|major|minor)(?![a-z])"
GARNISH = (
    r"(?i)[\[(]\s*(official\s*(music\s*)?(video|audio|visualiser|visualizer)|lyrics?(\s*video)?|audio|hd|hq|4k|full\s*album|free\s*download|explicit|clean|remaster(ed)?(\s*\d{4})?|\d{3,4}\s*kbps|"
    r"with\s*lyrics|music\s*video|mv|live|extended\s*mix)\s*[\])]"
)
SITE_PREFIX = r"(?i)^\s*(www\.[^\s_-]+|\[[^\]]*\.(com|net|org)\])\s*[-_ ]+"
VIDEO_ID = r"\[([A-Za-z0-9_-]{11})\]\s*$"
FEATURING = r"(?i)\s*[\[(]?\s*(?:feat\.?|ft\.?|featuring|with)\s+([^)\]]+)[\])]?\s*$"
DISC_TRACK, VINYL, TRACK = r"^\s*(\d{1,2})[-.](\d{2})\s*[-._ ]\s*(?=\S)", r"^\s*([A-F])(\d{1,2})\s*[-._ ]+(?=\S)", r"^\s*(\d{1,3})\s*(?:[-._)]\s*|\s)(?=\S)"
LAST_TRACK = 200
VOCABULARY = {
    "resolution": "2160p 1080p 1080i 720p 576p 576i 480p 480i 4320p 4k uhd fhd hd sd",
    "source": "bluray blu-ray bdrip brrip bdremux remux webrip web-dl webdl web hdtv pdtv dsr dvdrip dvd dvdscr dvdr hdrip camrip cam telesync telecine ts tc r5 vhsrip vodrip hdcam amzn nf dsnp hmax atvp hulu pcok stan crav uhdbd",
    "codec": "x264 x265 h264 h265 h.264 h.265 hevc avc av1 xvid divx vp9 mpeg2 10bit 8bit 10-bit hdr hdr10 hdr10+ dovi dv sdr hi10p avc1",
    "audio": "aac ac3 eac3 ddp dd dd+ dts dts-hd dtshd truehd atmos flac opus mp3 lpcm pcm aac2 ddp5 dd5 5.1 7.1 2.0 6ch 2ch",
    "edition": "extended unrated uncut directors director's theatrical remastered restored imax criterion anniversary special ultimate final collectors",
    "flag": "proper repack rerip internal limited complete multi dual subbed dubbed hardsub softsub subs nosub retail readnfo rartv rarbg sample",
    "language": "english french german spanish italian japanese korean chinese russian portuguese dutch polish swedish danish norwegian finnish hindi arabic turkish czech hungarian eng fre fra ger deu spa ita jpn jap kor "
                "chi rus por dut pol swe dan nor fin hin ara tur cze hun vostfr truefrench vf vo vost",
}
EPISODES = (
    r"(?i)(?<![a-z0-9])s(\d{1,2})[ ._-]?e(\d{1,3})(?:[ ._-]?e?(\d{1,3}))?(?![0-9])", r"(?i)(?<![a-z0-9])(\d{1,2})x(\d{1,3})(?![0-9])",
    r"(?i)(?<![a-z0-9])season[ ._-]?(\d{1,2})[ ._-]+episode[ ._-]?(\d{1,3})", r"(?i)(?<![a-z0-9])s(\d{1,2})(?![0-9ep])()",
)
RELEASE_YEAR, GROUP_TRAILER = r"(?<!\d)(19[3-9]\d|20[0-4]\d)(?!\d)", r"[-‑]\s*([A-Za-z0-9_.]{2,20})$"
FAN_GROUP, FAN_EPISODE, CHECKSUM = r"^\[([^\]]{2,30})\]\s*", r"\s-\s(\d{1,3})(?:v\d)?(?:\s|$|\[)", r"\[([0-9A-Fa-f]{8})\]"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _start(text: Column, pattern: str) -> Column:
    """Characters before the first match, or null."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, at - 1)


def _strip(text: Column, marks: str) -> Column:
    inner = "".join("\\" + c for c in marks)
    return F.regexp_replace(text, f"^[{inner}]+|[{inner}]+$", "")


def _first_of(stem: Column, shapes: tuple, name: str) -> Column:
    """struct(name: program or null) of the first shape that the stem begins with."""
    cases = [F.when(stem.rlike(f"(?i)^(?:{p})"), F.struct(F.lit(app).cast("string").alias(name))) for p, app in shapes]
    return F.coalesce(*cases)


def messaging(stem: Column) -> Column:
    """struct(from_app) of what a messenger or phone has exported."""
    return _first_of(stem, MESSAGING, "from_app")


def scan_name(stem: Column) -> Column:
    """struct(from_app) of what a scanner or scanning program has named."""
    return _first_of(stem, SCANNERS, "from_app")


def software(plain: Column, name: Column, kind: Column | None = None) -> Column:
    """struct(version, channel, platform_tag, installer, product, firm) of a name with a version or an installer's word in it.

    It is an installer if it says so beside a version or a word for setup, or with a version if it is of a kind that only installs. The product stands before the
    first of the two, and is firm where a version agrees with either.
    """
    version, tag = _found(plain, VERSION), F.lower(_found(plain, INSTALLER))
    says = tag.isNotNull() & (version.isNotNull() | name.rlike(r"(?i)\b(setup|install)"))
    by_kind = version.isNotNull() & (F.coalesce(kind.isin(*INSTALLED_KINDS), F.lit(False)) if kind is not None else F.lit(False))
    cut = F.least(_start(plain, VERSION), _start(plain, INSTALLER))
    product = F.nullif(F.trim(F.regexp_replace(F.left(plain, cut), "[-_.]+", " ")), F.lit(""))
    found = F.struct(
        version.alias("version"), F.lower(_found(plain, VERSION, 2)).alias("channel"), tag.alias("platform_tag"), (says | by_kind).alias("installer"),
        F.when(says | by_kind, product).alias("product"), (version.isNotNull() & (tag.isNotNull() | by_kind)).alias("firm"),
    )
    return F.when(version.isNotNull() | tag.isNotNull(), found)


def sample(plain: Column) -> Column:
    """struct(sample_type, bpm, musical_key) of a producer's sample: a name with one of its words or a tempo."""
    kind = F.lower(_found(plain, SAMPLE_WORDS))
    said = F.coalesce(_found(plain, TEMPO, 1), _found(plain, TEMPO, 2)).try_cast("int")
    key = F.concat(_found(plain, MUSICAL_KEY), F.left(F.lower(_found(plain, MUSICAL_KEY, 2)), F.lit(3)))
    found = F.struct(kind.alias("sample_type"), F.when(said.between(40, 300), said).alias("bpm"), key.alias("musical_key"))
    return F.when(kind.isNotNull() | said.isNotNull(), found)


MUSIC = "struct<source_id:string,disc:int,side:string,track:int,featuring:string,artist:string,album:string,song_title:string>"


def music(stem: Column) -> Column:
    """struct(source_id, disc, side, track, featuring, artist, album, song_title): what stands before and behind ``Artist - Title`` comes off first.

    A number of up to 200 in front is a track, or disc and track, or a side of a record with a track. Two parts are artist and title, three have an album or a track
    in the middle; one part is a title only behind a track. Order is a guess, as a name can't tell it.
    """
    none, whole = F.lit(None).cast("string"), lambda c: c.try_cast("int")
    bare = F.regexp_replace(F.regexp_replace(stem, SITE_PREFIX, ""), GARNISH, " ")

    def with_id(text: Column) -> Column:
        known = F.when(~_found(text, VIDEO_ID).rlike(r"^\d+$"), _found(text, VIDEO_ID))
        return F.struct(known.alias("id"), F.when(known.isNotNull(), F.regexp_replace(text, VIDEO_ID, "")).otherwise(text).alias("text"))

    def numbered(x: Column) -> Column:
        text, cut = x["text"], lambda p: F.regexp_replace(x["text"], p, "")
        row = lambda disc, side, track, rest, plain: F.struct(
            x["id"].alias("id"), disc.cast("int").alias("disc"), side.cast("string").alias("side"), track.cast("int").alias("track"), _strip(F.replace(rest, F.lit("_-_"), F.lit(" - ")), " -_.").alias("text"), F.lit(plain).alias("plain"))
        number = whole(_found(text, TRACK))
        return (
            F.when(text.rlike(DISC_TRACK), row(whole(_found(text, DISC_TRACK)), none, whole(_found(text, DISC_TRACK, 2)), cut(DISC_TRACK), False))
            .when(text.rlike(VINYL), row(none, F.upper(_found(text, VINYL)), whole(_found(text, VINYL, 2)), cut(VINYL), False))
            .when(number <= LAST_TRACK, row(none, none, number, cut(TRACK), True)).otherwise(row(none, none, none, text, False))
        )

    def credited(x: Column) -> Column:
        """``_strip`` has taken blanks off, so what features stands at the end."""
        feature = _strip(_found(x["text"], FEATURING), " .-")
        text = F.trim(F.regexp_replace(x["text"], FEATURING, ""))
        parts = F.filter(F.transform(F.split(F.when(feature.isNotNull(), text).otherwise(x["text"]), r"\s+[-–—]\s+"), lambda p: F.trim(p)), lambda p: p != "")
        return F.struct(x.alias("x"), feature.alias("featuring"), parts.alias("parts"))

    def named(y: Column) -> Column:
        x, parts, n = y["x"], y["parts"], F.size(y["parts"])
        part = lambda k: F.get(parts, F.lit(k))
        middle = part(1).rlike(r"^\d+$")
        track = F.when((n == 3) & middle & x["track"].isNull(), whole(part(1))).otherwise(x["track"])
        title = F.when(n == 2, part(1)).when(n == 3, part(2)).when((n == 1) & x["plain"], part(0))
        return F.struct(x["id"], x["disc"], x["side"], track, y["featuring"], F.when(n.isin(2, 3), part(0)), F.when((n == 3) & ~middle, part(1)), title).cast(MUSIC)

    return bind(bare, lambda t: bind(with_id(t), lambda a: bind(numbered(a), lambda b: bind(credited(b), named))))


RELEASE = ("struct<label:string,title:string,season:int,episode:int,release_year:int,release_group:string,checksum:string,resolution:string,source:string,codec:string,audio:string,edition:string,flag:string,"
           "language:string,release_sample:boolean>")


def _tokens(text: Column) -> Column:
    """array<struct<token, at>>: the words of a text and where they begin."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\s*\S+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<token:string,at:int>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        token, end = F.ltrim(piece), acc["end"] + F.char_length(piece)
        return F.struct(end.alias("end"), F.array_append(acc["found"], F.struct(token.alias("token"), (end - F.char_length(token)).alias("at"))).alias("found"))

    return F.aggregate(pieces, start, step, lambda acc: acc["found"])


def release(flat: Column, name: Column) -> Column:
    """RELEASE of a film's or an episode's name: the title ends at the first word of the vocabulary, the first mark of a season or the year.

    Two kinds of vocabulary words, an episode, or a year with one such word make a release. A group in brackets in front reads a number behind a dash as the episode.
    """
    groups = {}
    for group, words in VOCABULARY.items():
        for w in words.split():
            groups.setdefault(w, group)
    known = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    whole = lambda c: c.try_cast("int")

    def marked(text: Column) -> Column:
        words = F.transform(_tokens(text), lambda t: F.struct(t["at"].alias("at"), _strip(F.lower(t["token"]), "[](){}").alias("word")))
        hits = F.filter(F.transform(words, lambda t: F.struct(t["at"].alias("at"), t["word"].alias("word"), F.element_at(known, t["word"]).alias("group"))), lambda t: t["group"].isNotNull())
        fan = F.when(text.rlike(FAN_GROUP), F.struct(_found(text, FAN_GROUP).alias("group"), F.char_length(F.regexp_extract(text, FAN_GROUP, 0)).alias("end")))
        cases = [F.when(text.rlike(p), F.struct(F.nullif(whole(_found(text, p)), F.lit(0)).alias("season"), whole(_found(text, p, 2)).alias("episode"), _start(text, p).alias("at"))) for p in EPISODES]
        mark = F.coalesce(*cases)
        fan_mark = F.struct(F.lit(None).cast("int").alias("season"), whole(_found(text, FAN_EPISODE)).alias("episode"), _start(text, FAN_EPISODE).alias("at"))
        mark = F.when(mark["episode"].isNull() & fan.isNotNull() & text.rlike(FAN_EPISODE), fan_mark).when(mark["at"].isNotNull(), mark)
        return F.struct(text.alias("text"), F.size(words).alias("n"), hits.alias("hits"), fan.alias("fan"), mark.alias("mark"))

    def told(m: Column) -> Column:
        text, hits, fan, mark = m["text"], m["hits"], m["fan"], m["mark"]
        kinds = F.size(F.array_distinct(F.transform(hits, lambda h: h["group"])))
        year, year_at = whole(_found(text, RELEASE_YEAR)), _start(text, RELEASE_YEAR)
        strength = kinds + F.when(mark["episode"].isNotNull(), 2).otherwise(0) + F.when(year.isNotNull() & (kinds > 0), 1).otherwise(0)
        first_word = F.get(F.filter(hits, lambda h: h["at"] > 0), F.lit(0))["at"]
        ends = [F.when(c > 0, c) for c in (first_word, mark["at"], year_at)]
        head = F.left(text, F.least(*ends, F.char_length(text)))
        head = F.when(fan.isNotNull(), F.substring(head, fan["end"] + 1, F.char_length(text))).otherwise(head)
        title = F.nullif(_strip(F.regexp_replace(head, r"\s{2,}", " "), " -._[]()"), F.lit(""))
        trailer = _found(text, GROUP_TRAILER)
        group = F.coalesce(fan["group"], F.when(F.element_at(known, F.lower(trailer)).isNull(), trailer))
        label = F.when(mark["episode"].isNotNull(), "episode").when(mark["season"].isNotNull(), "season").otherwise("scene-release")
        of = [_hit(hits, g) for g in VOCABULARY]
        sampled = F.lower(name).startswith("sample") | F.lower(name).contains(".sample.")
        found = F.struct(label, title, mark["season"], mark["episode"], year, group, F.upper(_found(text, CHECKSUM)), *of, sampled).cast(RELEASE)
        return F.when((m["n"] >= 2) & (strength >= 2), found)

    return bind(flat, lambda t: bind(marked(t), told))


def _hit(hits: Column, group: str) -> Column:
    return F.get(F.filter(hits, lambda h: h["group"] == group), F.lit(0))["word"]


def flattened(plain: Column, stem: Column) -> Column:
    """Dots as blanks where they stand for them: two or more, and no blank in the stem."""
    dotted = (F.char_length(stem) - F.char_length(F.replace(stem, F.lit("."), F.lit(""))) >= 2) & ~stem.contains(" ")
    return F.when(dotted, F.replace(plain, F.lit("."), F.lit(" "))).otherwise(plain)


def media_facts(name: Column, kind: Column | None = None) -> list[Column]:
    """The columns of all detectors for a file name, and of its kind if that is known."""
    ext = F.regexp_extract(name, r"^.+\.([A-Za-z0-9]{1,10})$", 1)
    stem = F.when(ext != "", F.regexp_replace(name, r"\.[A-Za-z0-9]{1,10}$", "")).otherwise(name)
    plain = F.replace(stem, F.lit("_"), F.lit(" "))
    detectors: dict[str, Callable[[], Column]] = {
        "messaging": lambda: messaging(stem), "scan_name": lambda: scan_name(stem), "software": lambda: software(plain, name, kind), "sample": lambda: sample(plain), "music": lambda: music(stem),
        "release": lambda: release(flattened(plain, stem), name),
    }
    return [make().alias(k) for k, make in detectors.items()]

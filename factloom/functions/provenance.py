"""Where a file came from: what systems and browsers record beside it, and what its path says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import hosts
from factloom.functions.derive import LIKELY, STRONG, WEAK

# Programs that write files, by words in their names, in the order they are tried, with how a file then arrived.
AGENTS = (
    ("safari", "Safari", "download"), ("google chrome", "Chrome", "download"), ("chromium", "Chromium", "download"), ("firefox", "Firefox", "download"), ("microsoft edge", "Edge", "download"),
    ("brave browser", "Brave", "download"), ("arc", "Arc", "download"), ("opera", "Opera", "download"), ("orion", "Orion", "download"), ("mail", "Mail", "email"), ("microsoft outlook", "Outlook", "email"),
    ("airmail", "Airmail", "email"), ("spark", "Spark", "email"), ("thunderbird", "Thunderbird", "email"), ("messages", "Messages", "message"), ("whatsapp", "WhatsApp", "message"), ("telegram", "Telegram", "message"),
    ("signal", "Signal", "message"), ("slack", "Slack", "message"), ("discord", "Discord", "message"), ("microsoft teams", "Teams", "message"), ("transmission", "Transmission", "torrent"),
    ("qbittorrent", "qBittorrent", "torrent"), ("deluge", "Deluge", "torrent"), ("folx", "Folx", "download"), ("curl", "curl", "download"), ("wget", "wget", "download"), ("dropbox", "Dropbox", "cloud"),
    ("google drive", "Google Drive", "cloud"), ("onedrive", "OneDrive", "cloud"), ("finder", "Finder", "airdrop"), ("airdrop", "AirDrop", "airdrop"), ("sharingd", "AirDrop", "airdrop"), ("bluetooth", "Bluetooth", "airdrop"),
    ("xcode", "Xcode", "download"), ("steam", "Steam", "download"), ("zoom", "Zoom", "message"),
)
# Parts of paths that tell a place or a cloud service, in the order they are tried.
PLACES = (
    ("/downloads", "downloads"), ("/desktop", "desktop"), ("/documents", "documents"), ("/pictures", "pictures"), ("/movies", "movies"), ("/videos", "movies"), ("/music", "music"), ("/.trash", "trash"),
    ("$recycle.bin", "trash"), ("/trash", "trash"), ("/tmp", "temp"), ("/temp", "temp"), ("/var/folders", "temp"), ("/library/caches", "cache"), ("/appdata/local/temp", "temp"),
)
CLOUDS = (
    ("dropbox", "Dropbox"), ("google drive", "Google Drive"), ("googledrive", "Google Drive"), ("onedrive", "OneDrive"), ("com~apple~clouddocs", "iCloud Drive"), ("icloud drive", "iCloud Drive"),
    ("mobile documents", "iCloud Drive"), ("pcloud", "pCloud"), ("mega", "MEGA"), ("box sync", "Box"), ("sync.com", "Sync"), ("nextcloud", "Nextcloud"), ("owncloud", "ownCloud"), ("proton drive", "Proton Drive"),
    ("creative cloud files", "Adobe"),
)
#: Zones of the mark that Windows puts on files from elsewhere, and what they say.
ZONES = {"1": "network", "3": "download", "4": "download"}


def agent(name: Column) -> Column:
    """struct(app, origin) of the program that wrote a file: the first whose word its name holds; an unknown one has downloaded it."""
    low = F.lower(name)
    told = lambda app, origin: F.struct(app.alias("app"), F.lit(origin).alias("origin"))
    cases = reduce(lambda c, a: c.when(low.contains(a[0]), told(F.lit(a[1]), a[2])), AGENTS[1:], F.when(low.contains(AGENTS[0][0]), told(F.lit(AGENTS[0][1]), AGENTS[0][2])))
    return F.when(F.coalesce(name, F.lit("")) != "", F.coalesce(cases, told(name, "download")))


def _zone(text: Column, key: str) -> Column:
    """The value of a key of a zone mark; of several lines the last counts."""
    found = F.regexp_extract_all(text, F.lit(rf"(?im)^[^\S\r\n]*{key}[^\S\r\n]*=(.*)$"), F.lit(1))
    return F.nullif(F.trim(F.element_at(F.when(F.size(found) > 0, found), -1)), F.lit(""))


def provenance(path: Column, where_froms: Column | None = None, quarantine: Column | None = None, zone: Column | None = None) -> Column:
    """struct(place, removable, cloud, from_app, origin, origin_confidence, downloaded, quarantined, from_url, referrer, from_host, source).

    ``where_froms``: URLs, that of the download first; ``quarantine``: "flags;seconds in hex;program;id"; ``zone``: the text of a zone mark. What a system records
    tells more than a path: a program's origin is sure, then a cloud folder's and that of a record count, and a folder of downloads is a guess.
    """
    none = F.lit(None).cast("string")
    where_froms = where_froms if where_froms is not None else F.lit(None).cast("array<string>")
    quarantine, zone = (c if c is not None else none for c in (quarantine, zone))
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    place, cloud = hosts.first_marker(low, list(PLACES)), hosts.first_marker(low, list(CLOUDS))
    fields = F.split(quarantine, ";")
    program = agent(F.get(fields, F.lit(2)))
    hexadecimal = F.when(F.get(fields, F.lit(1)).rlike("^[0-9A-Fa-f]{1,12}$"), F.conv(F.get(fields, F.lit(1)), 16, 10).try_cast("long"))
    mark = _zone(zone, "ZoneId")
    urls = F.filter(F.concat(F.coalesce(where_froms, F.array().cast("array<string>")), F.array(_zone(zone, "HostUrl"), _zone(zone, "ReferrerUrl"))), lambda u: F.coalesce(u, F.lit("")) != "")
    url, host = F.get(urls, F.lit(0)), hosts.url_host(F.get(urls, F.lit(0)))
    zoned = F.element_at(F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair]), mark)
    recorded = F.coalesce(zoned, F.when(url.isNotNull(), F.lit("download")))
    origin = F.coalesce(program["origin"], F.when(cloud.isNotNull(), "cloud"), recorded, F.when(place == "downloads", "download"))
    sure = F.when(program.isNotNull(), STRONG).when(cloud.isNotNull() | recorded.isNotNull(), LIKELY).when(place == "downloads", WEAK)
    return F.struct(
        place.alias("place"), F.coalesce(low.rlike("^/(media|mnt|run/media|volumes)/"), F.lit(False)).alias("removable"), cloud.alias("cloud"), program["app"].alias("from_app"), origin.alias("origin"), sure.alias("origin_confidence"),
        F.when(hexadecimal > 0, F.timestamp_seconds(hexadecimal)).alias("downloaded"), F.coalesce(F.when(F.coalesce(F.get(fields, F.lit(2)), F.lit("")) != "", F.lit(True)), mark.isin("3", "4")).alias("quarantined"),
        url.alias("from_url"), F.get(urls, F.lit(1)).alias("referrer"), hosts.strip_decoration(host).alias("from_host"), F.nullif(hosts.source(host), F.lit("")).alias("source"),
    )

from pyspark.sql import functions as F

from factloom.functions.media_names import media_facts

#: name, kind, detector, what it finds; None where it finds nothing.
CASES = [
    ("IMG-20240115-WA0007.jpg", None, "messaging", {"from_app": "WhatsApp"}), ("whatsapp image 2024.jpg", None, "messaging", {"from_app": "WhatsApp"}), ("IMG_1234_iOS.heic", None, "messaging", {}), ("photo_2024-01-02_x.jpg", None, "messaging", {"from_app": "Telegram"}),
    ("received_12345.jpg", None, "messaging", None), ("my IMG-20240115-WA0007.jpg", None, "messaging", None),
    ("scan0001.pdf", None, "scan_name", {}), ("CamScanner 12.pdf", None, "scan_name", {"from_app": "CamScanner"}), ("NEW DOC 3.pdf", None, "scan_name", {}), ("img20240101_1234.jpg", None, "scan_name", {}), ("img20240101_12345.jpg", None, "scan_name", None),
    ("a scan.pdf", None, "scan_name", None),
    ("firefox-1.5.0.12.installer.exe", None, "software", {"version": "1.5.0.12", "platform_tag": "installer", "installer": True, "product": "firefox", "firm": True}),
    ("AdobeReader_11.0.10.dmg", "disk-image", "software", {"version": "11.0.10", "installer": True, "product": "AdobeReader", "firm": True}), ("AdobeReader_11.0.10.dmg", None, "software", {"version": "11.0.10", "firm": False, "installer": False}),
    ("setup.exe", None, "software", {"platform_tag": "setup", "installer": True, "firm": False}), ("tool-v2.3-beta.zip", None, "software", {"version": "2.3", "channel": "beta", "installer": False, "firm": False}), ("Notes 2024.txt", None, "software", None),
    ("Kick_808 120bpm Amin.wav", None, "sample", {"sample_type": "kick", "bpm": 120, "musical_key": "Amin"}), ("bpm 95 thing.wav", None, "sample", {"bpm": 95}), ("loop 20bpm F#major.wav", None, "sample", {"sample_type": "loop", "musical_key": "F#maj"}), ("song.wav", None, "sample", None),
    ("01 - Artist - Song (Official Video).mp3", None, "music", {"track": 1, "artist": "Artist", "song_title": "Song"}),
    ("1-02 Artist - Album - Title feat. Other.mp3", None, "music", {"disc": 1, "track": 2, "featuring": "Other", "artist": "Artist", "album": "Album", "song_title": "Title"}),
    ("B2 Name - Thing.flac", None, "music", {"side": "B", "track": 2, "artist": "Name", "song_title": "Thing"}), ("03 Only Title.mp3", None, "music", {"track": 3, "song_title": "Only Title"}), ("A - 12 - B.mp3", None, "music", {"track": 12, "artist": "A", "song_title": "B"}),
    ("www.site.com - A - B [dQw4w9WgXcQ].mp3", None, "music", {"source_id": "dQw4w9WgXcQ", "artist": "A", "song_title": "B"}), ("2001 A Space Odyssey.mkv", None, "music", {}), ("a_-_b.mp3", None, "music", {"artist": "a", "song_title": "b"}), ("plain.mp3", None, "music", {}),
    ("Show.Name.S02E05.1080p.WEB-DL.H264-GRP.mkv", None, "release", {"label": "episode", "title": "Show Name", "season": 2, "episode": 5, "release_group": "GRP", "resolution": "1080p", "source": "web-dl", "release_sample": False}),
    ("[Fan Sub] Great Title - 07 [1080p] [ABCD1234].mkv", None, "release", {"label": "episode", "title": "Great Title", "episode": 7, "release_group": "Fan Sub", "checksum": "ABCD1234", "resolution": "1080p", "release_sample": False}),
    ("Film.Title.1999.720p.BluRay.german.mkv", None, "release", {"label": "scene-release", "title": "Film Title", "release_year": 1999, "resolution": "720p", "source": "bluray", "language": "german", "release_sample": False}),
    ("sample.film.s03.720p.x264.mkv", None, "release", {"label": "season", "title": "sample film", "season": 3, "resolution": "720p", "codec": "x264", "flag": "sample", "release_sample": True}),
    ("Two Words.mkv", None, "release", None), ("Holiday 2019.mkv", None, "release", None), ("word.mkv", None, "release", None),
]


def test_every_detector_finds_what_a_name_holds(spark):
    rows = [(k, name, kind) for k, (name, kind, *_) in enumerate(CASES)] + [(-1, None, None), (-2, "", None)]
    df = spark.createDataFrame(rows, "k int, name string, kind string")
    got = {r.k: r for r in df.select("k", *media_facts(F.col("name"), F.col("kind"))).collect()}
    for k, (name, _, detector, want) in enumerate(CASES):
        found = got[k][detector]
        assert (None if found is None else {a: b for a, b in found.asDict().items() if b is not None}) == want, (name, found)
    assert all(v is None or not any(v) for k in (-1, -2) for v in got[k][1:])

"""The word lists, code tables and limits that every rule of the gate shares.

These are part of the public contract (extensions, kinds, codes, keys, limits), so they are
plain data here and nothing below computes anything.
"""

# --- fixed values: severities (value = exit code) ---------------------------------------
PASS, WARN, USAGE, FAIL, BLOCK = 0, 1, 2, 3, 4
SEVERITY_NAMES = {0: "PASS", 1: "WARN", 2: "USAGE", 3: "FAIL", 4: "BLOCK"}

# --- fixed values: media extensions -> category -----------------------------------------
MEDIA_EXTENSIONS = {
    "video": ["mkv", "webm", "mp4", "m4v", "mov", "avi", "ts", "m2ts", "mts", "mpg", "mpeg",
              "vob", "flv", "wmv", "asf", "3gp", "ogv"],
    "audio": ["mka", "mp3", "flac", "wav", "aac", "m4a", "ogg", "oga", "opus", "wma"],
    "subtitle": ["mks"],
}

# --- fixed values: extension -> kinds of content it may hold ------------------------------
EXTENSION_KINDS = {
    "mkv": ["matroska"], "mka": ["matroska"], "mks": ["matroska"],
    "webm": ["webm", "matroska"],
    "mp4": ["mp4"], "m4v": ["mp4"], "mov": ["mp4"], "m4a": ["mp4"], "3gp": ["mp4"], "3g2": ["mp4"],
    "avi": ["avi"],
    "ts": ["mpegts"], "m2ts": ["mpegts"], "mts": ["mpegts"],
    "mpg": ["mpegps"], "mpeg": ["mpegps"], "vob": ["mpegps"],
    "flv": ["flv"],
    "wmv": ["asf"], "wma": ["asf"], "asf": ["asf"],
    "ogg": ["ogg"], "ogv": ["ogg"], "oga": ["ogg"], "opus": ["ogg"],
    "flac": ["flac"], "wav": ["wav"], "mp3": ["mp3"],
    "srt": ["text"], "ass": ["text"], "ssa": ["text"], "vtt": ["text"], "sub": ["text"],
    "txt": ["text"], "nfo": ["text"], "sfv": ["text"], "md5": ["text"], "sha256": ["text"],
    "idx": ["text"],
    "jpg": ["image"], "jpeg": ["image"], "png": ["image"], "gif": ["image"], "webp": ["image"],
    "bmp": ["image"],
    "par2": ["unknown"],
}

# --- fixed values: classes of content kinds -----------------------------------------------
VIDEO_KINDS = ["matroska", "webm", "mp4", "avi", "mpegts", "mpegps", "flv", "asf"]
AUDIO_KINDS = ["ogg", "flac", "wav", "mp3"]
DANGEROUS_KINDS = ["executable", "archive", "pdf", "html", "script"]

# --- fixed values: windows and limits -------------------------------------------------------
SNIFF_WINDOW = 8192            # bytes of the head that are sniffed
PAYLOAD_WINDOW = 1 << 20       # bytes of the head / tail searched for appended payloads
SIGNATURE_MAX_BYTES = 2047 << 20
EVIDENCE_LINES, EVIDENCE_LINE_BYTES, EVIDENCE_BYTES = 8, 512, 4096

# --- fixed values: appended-payload signatures in the order they are named ------------------
PAYLOAD_SIGNATURES = [("504B0304", "PK"), ("504B0506", "PK"), ("526172211A07", "Ra"),
                      ("377ABCAF271C", "7z"), ("7F454C46", "\\x7fE")]
STUB_TEXT = "This program cannot be run in DOS mode"

# --- fixed values: top-level domains that make a bare name a link ---------------------------
LINK_TLDS = ["com", "net", "org", "info", "biz", "io", "to", "cc", "tv", "me", "ru", "xyz",
             "site", "online", "club", "top", "link", "sh", "app", "dev", "co", "us", "uk", "de",
             "fr", "nl", "se", "eu", "pw", "ws", "su", "in", "cn", "tk", "ml", "ga", "cf", "gq",
             "stream", "live", "watch", "movie", "video", "download", "torrent", "zone", "space"]
LINK_TRAILING = ".,;:)]}"

# --- fixed values: notes ---------------------------------------------------------------------
NOTE_ROOTS = ["movie", "tvshow", "episodedetails", "musicvideo", "artist", "album", "movies"]
NOTE_ALLOWED_ELEMENTS = ["thumb", "fanart", "trailer", "episodeguide", "url", "videourl",
                         "thumburl", "path"]
TRUSTED_SITES = ["themoviedb.org", "imdb.com", "thetvdb.com", "musicbrainz.org"]
TRUSTED_PATHS = {"imdb.com": "/title/"}
BARE_ID_SITE = "imdb.com"

# --- fixed values: provenance keys -> description --------------------------------------------
PROVENANCE_KEYS = {
    "ownr": "purchaser name",
    "apID": "iTunes account id",
    "purd": "purchase date",
    "xid ": "vendor identifier",
    "cprt": "copyright notice",
    "©too": "encoding tool",
    "©enc": "encoded by",
    "©swr": "software",
    "akID": "iTunes account kind",
    "atID": "iTunes artist id",
    "cnID": "iTunes catalog id",
    "geID": "iTunes genre id",
    "plID": "iTunes playlist id",
    "sfID": "iTunes storefront id",
    "flvr": "iTunes flavour",
    "©url": "URL",
    "ldes": "long description",
    "desc": "description",
    "©cmt": "comment",
    "----:com.apple.iTunes:iTunMOVI": "iTunes movie XML",
    "----:com.apple.iTunes:iTunEXTC": "iTunes content rating",
    "----:com.apple.iTunes:Encoding Params": "encoder parameters",
    "----:com.apple.iTunes:iTunNORM": "iTunes normalisation",
    "----:com.apple.iTunes:iTunes_CDDB_IDs": "CDDB ids",
    "----:com.apple.iTunes:iTunes_CDDB_1": "CDDB id",
    "----:com.apple.iTunes:iTunes_CDDB_TrackNumber": "CDDB track",
}
FREEFORM_PREFIX = "----:"
TOOL_KEYS = ["©too", "©enc", "©swr", "----:com.apple.iTunes:Encoding Params",
             "----:com.apple.iTunes:iTunNORM"]
INFO_TAGS = ["encoder", "encoded_by", "comment", "description", "creation_time", "handler_name"]

# --- fixed values: tags a rewrite always writes back -------------------------------------------
INERT_ITEM_TAGS = ["major_brand", "minor_version", "compatible_brands"]
INERT_PART_TAGS = {"handler_name": ["VideoHandler", "SoundHandler", "SubtitleHandler", "DataHandler"],
                   "vendor_id": ["FFMP", "[0][0][0][0]"]}

# --- fixed values: attachment types ---------------------------------------------------------------
FONT_MIMES = ["font/ttf", "font/otf", "font/collection", "font/sfnt",
              "application/x-truetype-font", "application/vnd.ms-opentype",
              "application/font-sfnt", "application/x-font-ttf", "application/x-font-otf",
              "application/x-font"]
FONT_EXTENSIONS = ["ttf", "otf", "ttc"]
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
TEXT_SUBTITLE_CODECS = ["subrip", "srt", "ass", "ssa", "webvtt", "mov_text", "text", "ttml"]

# --- fixed values: container names ---------------------------------------------------------------
CONTAINERS_EXACT = {"matroska,webm": "matroska", "mov,mp4,m4a,3gp,3g2,mj2": "mp4"}
CONTAINERS_FIRST = {"mpegts": "mpegts", "mpeg": "mpegps",
                    "srt": "subtitle", "ass": "subtitle", "webvtt": "subtitle",
                    "microdvd": "subtitle", "vobsub": "subtitle"}

# --- fixed values: language codes, canonical form first in each group -------------------------------
LANGUAGE_GROUPS = [
    ["eng", "en"], ["jpn", "ja"], ["ger", "deu", "de"], ["fre", "fra", "fr"], ["spa", "es"], ["ita", "it"],
    ["por", "pt"], ["rus", "ru"], ["chi", "zho", "zh"], ["kor", "ko"], ["dut", "nld", "nl"], ["swe", "sv"],
    ["nor", "no", "nob", "nno"], ["dan", "da"], ["fin", "fi"], ["pol", "pl"], ["cze", "ces", "cs"], ["hun", "hu"],
    ["tur", "tr"], ["ara", "ar"], ["heb", "he", "iw"], ["hin", "hi"], ["tha", "th"], ["vie", "vi"], ["ind", "id", "in"],
    ["gre", "ell", "el"], ["rum", "ron", "ro"], ["ukr", "uk"], ["bul", "bg"], ["hrv", "hr"], ["srp", "sr"],
    ["slv", "sl"], ["slo", "slk", "sk"], ["tam", "ta"], ["tel", "te"], ["ben", "bn"], ["may", "msa", "ms"],
    ["per", "fas", "fa"], ["cat", "ca"], ["baq", "eus", "eu"], ["glg", "gl"], ["ice", "isl", "is"], ["lit", "lt"],
    ["lav", "lv"], ["est", "et"], ["tgl", "fil", "tl"], ["mal", "ml"], ["kan", "kn"], ["mar", "mr"], ["urd", "ur"],
    ["pan", "pa"], ["guj", "gu"], ["lat", "la"], ["afr", "af"], ["alb", "sqi", "sq"], ["arm", "hye", "hy"],
    ["aze", "az"], ["bos", "bs"], ["bur", "mya", "my"], ["geo", "kat", "ka"], ["kaz", "kk"], ["khm", "km"],
    ["mac", "mkd", "mk"], ["mon", "mn"], ["nep", "ne"], ["sin", "si"], ["swa", "sw"], ["uzb", "uz"],
    ["wel", "cym", "cy"], ["gle", "ga"], ["mao", "mri", "mi"], ["tib", "bod", "bo"], ["yid", "yi"], ["zul", "zu"],
    ["und"], ["mul"], ["zxx"], ["mis"],
]

# --- fixed values: code points -> names (ITU-T H.273 as media tools name them) ------------------------
CODE_TABLES = {
    "primaries": {1: "bt709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "film",
                  9: "bt2020", 10: "smpte428", 11: "smpte431", 12: "smpte432", 22: "jedec-p22"},
    "transfer": {1: "bt709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m",
                 8: "linear", 9: "log100", 10: "log316", 11: "iec61966-2-4", 12: "bt1361e",
                 13: "iec61966-2-1", 14: "bt2020-10", 15: "bt2020-12", 16: "smpte2084",
                 17: "smpte428", 18: "arib-std-b67"},
    "matrix": {0: "gbr", 1: "bt709", 4: "fcc", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m",
               8: "ycgco", 9: "bt2020nc", 10: "bt2020c", 11: "smpte2085", 12: "chroma-derived-nc",
               13: "chroma-derived-c", 14: "ictcp"},
    "range": {1: "tv", 2: "pc"},
}
TRANSFER_LABELS = {"smpte2084": "hdr10", "arib-std-b67": "hlg"}
UNSIGNALLED_NAMES = ["", "unknown", "unspecified", "reserved"]

# --- fixed values: bounds of typed fields ------------------------------------------------------------
MAX_LUMINANCE, MAX_CONTENT_LIGHT = 100000.0, 65535
MAX_DV_PROFILE, MAX_DV_LEVEL, MAX_DV_COMPAT, MAX_ENUM_LENGTH = 127, 63, 15, 32

# --- fixed values: callers, their job variables and exit codes -----------------------------------------
ADAPTERS = ["sabnzbd", "nzbget", "sonarr", "radarr"]
EXIT_CODES = {"sabnzbd": (0, 1, 0, 2, 130), "nzbget": (93, 94, 95, 94, 94),
              "sonarr": (0, 1, 0, 2, 130), "radarr": (0, 1, 0, 2, 130)}
OUTCOMES = ["ran", "skipped", "usage", "interrupted"]
CONTROL_LINE = "[NZB] MARK=BAD"

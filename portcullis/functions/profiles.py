"""The built-in policy profiles. Each states only what differs from the default."""

DEFAULT_PROFILE = "homelab"

# --- fixed values: sidecar lists -----------------------------------------------------------
_BLOCKED = ["lnk", "url", "exe", "scr", "com", "pif", "bat", "cmd", "ps1", "vbs", "vbe", "js",
            "jse", "wsf", "wsh", "hta", "jar", "msi", "msp", "dmg", "pkg", "app", "sh", "command",
            "py", "pl", "rb", "deb", "rpm", "apk", "iso", "img", "reg", "cpl", "dll", "so", "dylib"]
_PLAIN = ["srt", "ass", "ssa", "sub", "idx", "vtt", "sfv", "par2", "md5", "sha256"]

# --- fixed values: default settings --------------------------------------------------------
HOMELAB = {
    "description": "The default: nothing audible or readable is lost, identifying metadata is.",
    "languages.keep": ["*"],
    "languages.prefer_original": True,
    "languages.und": "keep",
    "audio.drop_commentary": False,
    "audio.keep_first": False,
    "subtitles.keep_forced": True,
    "subtitles.drop_sdh_duplicates": False,
    "subtitles.scan_links": True,
    "subtitles.links": "warn",
    "chapters.keep": True,
    "attachments.fonts": "keep_if_text_subs",
    "attachments.cover_art": "keep",
    "attachments.other": "block",
    "metadata.strip_title": True,
    "metadata.strip_tags": True,
    "metadata.strip_track_titles": False,
    "metadata.strip_provenance": True,
    "metadata.links": "warn",
    "metadata.provenance": "warn",
    "streams.allow_data_tags": ["tmcd", "text"],
    "verify.tier": "quick",
    "verify.stream_hash": True,
    "safety.refuse_root": True,
    "safety.hardlinks": "skip",
    "safety.exec_permissions": "warn",
    "safety.clamav": "off",
    "sidecars.allow": ["nfo"] + _PLAIN + ["jpg", "jpeg", "png", "webp", "txt"],
    "sidecars.block": _BLOCKED,
}

ANIME = {
    "description": "For works whose typeset subtitles need their fonts; commentary goes.",
    "audio.drop_commentary": True,
    "attachments.fonts": "keep",
    "sidecars.allow": ["nfo"] + _PLAIN + ["jpg", "jpeg", "png", "webp", "txt", "ttf", "otf", "ttc"],
}

ARCHIVE = {
    "description": "One language and bare parts; foreign links and origin marks stop an item.",
    "languages.keep": ["eng"],
    "languages.prefer_original": False,
    "languages.und": "drop",
    "audio.drop_commentary": True,
    "subtitles.keep_forced": False,
    "subtitles.links": "fail",
    "chapters.keep": False,
    "attachments.fonts": "drop",
    "attachments.cover_art": "drop",
    "metadata.strip_track_titles": True,
    "metadata.links": "fail",
    "metadata.provenance": "fail",
    "safety.exec_permissions": "fail",
    "safety.clamav": "optional",
    "sidecars.allow": _PLAIN,
    "sidecars.block": _BLOCKED + ["nfo", "txt", "html", "htm"],
}

STRICT = {
    **ARCHIVE,
    "description": "As archive, with every byte decoded and a signature scan that must have run.",
    "streams.allow_data_tags": ["tmcd"],
    "verify.tier": "full",
    "safety.clamav": "required",
}

BUILTIN_OVERLAYS = {"homelab": {}, "anime": ANIME, "archive": ARCHIVE, "strict": STRICT}

# --- fixed values: allowed settings of the enumerated keys ----------------------------------
ENUM_VALUES = {
    "subtitles.links": ["warn", "fail"],
    "attachments.fonts": ["keep", "drop", "keep_if_text_subs"],
    "attachments.cover_art": ["keep", "drop"],
    "attachments.other": ["block", "drop"],
    "metadata.links": ["warn", "fail"],
    "metadata.provenance": ["warn", "fail"],
    "verify.tier": ["quick", "full", "none"],
    "safety.hardlinks": ["skip", "break", "copy"],
    "safety.exec_permissions": ["ignore", "warn", "fail"],
    "safety.clamav": ["off", "optional", "required"],
}

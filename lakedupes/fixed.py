"""Fixed values. They decide results, so they are stated here as plain text."""

# Audio file extensions.
AUDIO_EXTENSIONS = (".aac", ".flac", ".m4a", ".mp3", ".ogg", ".opus", ".wav", ".wma")

# Video file extensions.
VIDEO_EXTENSIONS = (".avi", ".mkv", ".mov", ".mp4", ".webm", ".wmv")

# Cover image extensions.
IMAGE_EXTENSIONS = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".webp")

# White space as Unicode text defines it, for use inside a [...] class under (?U).
SPACE = r"\s\x1c-\x1f"

# Copy markers at the end of a file stem, removed in this order.
# (?U) Unicode classes, (?d) only \n ends a line, (?i) any case.
COPY_SUFFIXES = (
    rf"(?Ud)[{SPACE}]*\(\d+\)$",
    rf"(?Udi)[{SPACE}]*-[{SPACE}]*Copie$",
    rf"(?Udi)[{SPACE}]*-[{SPACE}]*Copy$",
    r"(?Udi)[_ ]copy$",
    r"(?Ud)_\d+$",
)

# UTF-8 text that was read as Latin-1.
MOJIBAKE = r"Ã[\x80-\xbf]|Ã[©¨ ´¹²³¼½¾]|Â[\xa0-\xbf]|Ã\x83Â"

# Penalties of the name quality score.
PENALTY_MOJIBAKE = 10
PENALTY_COPY_SUFFIX = 5
PENALTY_OUTER_SPACE = 2
PENALTY_SPACE_RUN = 1

# An album folder name followed by [number] and possibly [year].
ALBUM_ID_SUFFIX = r"(?Ud)^(.*?)[\s\x1c-\x1f]*\[\d+\](?:[\s\x1c-\x1f]*\[\d{4}\])?$"

# Size units, each 1024 times the one before.
SIZE_UNITS = ("o", "Ko", "Mo", "Go", "To", "Po")

# Bytes read from the head of an object for its tags, and per step when hashing.
HEAD_BYTES = 256 * 1024
CHUNK_BYTES = 1024 * 1024

# Folder categories.
ORPHAN = "orphan"
BOTH_MUSIC = "both_music"

# Default choices.
DEFAULT_KEEP = "cleanest,shortest,oldest"
DEFAULT_RULES = ("strip-spaces",)
DEFAULT_FOLDER_PREFIX = "Music/"
DEFAULT_FOLDER_DEPTH = 3

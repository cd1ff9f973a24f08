"""Path columns: parts of a path, media kinds, copies, companions and containment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Suffixes by kind, package folders, sidecars, the order in which a group's primary is
# chosen, folder names that tell copies apart badly, markers of copies.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".heic", ".heif"]
VIDEO_SUFFIXES = [".mp4", ".m4v", ".mov", ".avi", ".mkv", ".webm", ".wmv", ".flv", ".mpg", ".mpeg", ".m2ts"]
PACKAGE_SUFFIXES = [".photoslibrary", ".app", ".fcpbundle", ".aplibrary", ".imovielibrary"]
SIDECAR_SUFFIXES = [".aae", ".xmp", ".thm", ".json", ".txt"]
PRIMARY_ORDER = [".heic", ".heif", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp", ".mov", ".mp4", ".m4v", ".avi", ".mkv"]
UNHELPFUL_PARENTS = ["", ".", "/", "photos", "pictures", "images", "media", "downloads", "desktop", "documents", "camera roll", "dcim", "export", "exports", "untitled", "new folder", "temp", "tmp"]
COPY_MARKERS = r"(?i)\bcopy\b|\(\d+\)\s*$|[-_ ]\d+\s*$|\bduplicate\b"
LONGEST_PARENT = 40


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder; empty where there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot; a leading dot alone starts no extension."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    own = name(path)
    return F.substring(own, F.lit(1), F.length(own) - F.length(suffix(path)))


def kind(path: Column) -> Column:
    """image, video or null, by the suffix."""
    own = F.lower(suffix(path))
    return F.when(own.isin(IMAGE_SUFFIXES), "image").when(own.isin(VIDEO_SUFFIXES), "video")


def in_package(relative: Column) -> Column:
    """Whether a folder on the way is a package."""
    return relative.rlike(r"(?i)(" + "|".join(s.replace(".", r"\.") for s in PACKAGE_SUFFIXES) + ")/")


def hidden(relative: Column) -> Column:
    return relative.rlike(r"(^|/)\.")


def is_sidecar(path: Column) -> Column:
    return F.lower(suffix(path)).isin(SIDECAR_SUFFIXES)


def primary_rank(path: Column) -> Column:
    """Place in the order of primaries, from 0; behind all where the suffix isn't in it."""
    at = F.array_position(F.array(*map(F.lit, PRIMARY_ORDER)), F.lower(suffix(path)))
    return F.when(at > 0, at - 1).otherwise(len(PRIMARY_ORDER)).cast("int")


def looks_like_copy(path: Column) -> Column:
    return stem(path).rlike(COPY_MARKERS)


def derived_name(own_stem: Column, group_stems: Column) -> Column:
    """Whether the stem strictly extends another stem of the group."""
    return F.exists(group_stems, lambda o: (o != own_stem) & F.startswith(own_stem, o))


def disambiguator(path: Column) -> Column:
    """The folder's name where it helps to tell copies apart, else null."""
    own = F.trim(name(parent(path)))
    return F.when(~F.lower(own).isin(UNHELPFUL_PARENTS) & (F.length(own) <= LONGEST_PARENT), own)


def within(path: Column, roots: Column) -> Column:
    """Whether the path is one of the roots or below one, segment-wise."""
    return F.exists(roots, lambda r: (path == r) | F.startswith(path, F.concat(r, F.lit("/"))))


def case_only(a: Column, b: Column) -> Column:
    return (F.lower(a) == F.lower(b)) & (a != b)


def sample_times(duration: Column, samples: Column, inset: float = 0.05) -> Column:
    """Evenly spaced times inset from both ends; the middle for one sample or no duration."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(samples, F.lit(2)) - 1), lambda i: duration * inset + duration * (1 - 2 * inset) * i / (samples - 1))
    return F.when((samples <= 1) | (duration <= 0), F.array(F.greatest(duration, F.lit(0.0)) / 2)).otherwise(spread)

"""What an encoder of images is given: metadata, colour mode and depth, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is kept of an image's information when metadata is stripped.
SAVED = ("n_frames", "loop", "duration", "background")
#: Modes that a JPEG XL encoder takes, and what the others become; any further one becomes RGB.
JXL_MODES = ("RGB", "RGBA", "L", "LA", "I;16", "F")
JXL_SUBSTITUTES = {"1": "L", "I": "I;16", "PA": "RGBA", "CMYK": "RGB", "YCbCr": "RGB", "LAB": "RGB", "HSV": "RGB"}
#: Fixed value: the deepest PNG that pngout takes.
PNGOUT_DEPTH = 8


def saved_info(info: Column, keep_metadata: bool = False) -> Column:
    """The entries of the map ``info`` that go into the new file."""
    return info if keep_metadata else F.map_filter(info, lambda k, _: k.isin(*SAVED))


def jxl_info(info: Column, keep_metadata: bool = False) -> Column:
    """The same for JPEG XL: an empty ``exif`` keeps the encoder from reading it off the image itself."""
    return info if keep_metadata else F.map_concat(saved_info(info), F.create_map(F.lit("exif"), F.lit("")))


def jxl_mode(mode: Column, transparent: Column) -> Column:
    """The mode that an image of ``mode`` is encoded in; a palette becomes RGBA if it has transparency."""
    out = F.when(mode.isin(*JXL_MODES), mode).when(mode == "P", F.when(transparent, "RGBA").otherwise("RGB"))
    for other, instead in JXL_SUBSTITUTES.items():
        out = out.when(mode == other, instead)
    return out.when(mode.isNotNull(), "RGB")


def pngout_takes(depth: Column) -> Column:
    """Whether pngout can work on a PNG of this bit depth; not where it is unknown."""
    return F.coalesce(depth.between(1, PNGOUT_DEPTH), F.lit(False))

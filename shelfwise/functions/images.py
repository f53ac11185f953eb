"""Perceptual hashes of small grey images, and file kinds by their first bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, KEPT = 32, 8
_COS = np.cos((2 * np.arange(SIDE)[None, :] + 1) * np.arange(KEPT)[:, None] * np.pi / (2 * SIDE))


def _hex(values: np.ndarray) -> list[str]:
    """Rows of 64 numbers as hex bits: above the row's upper median or not."""
    bits = values > np.sort(values, axis=1)[:, 32:33]
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)]


@F.pandas_udf(T.StructType([T.StructField("p", T.StringType()), T.StructField("a", T.StringType())]))
def grey_hashes(pixels: pd.Series) -> pd.DataFrame:
    """DCT hash and mean hash of 1024 luminance values, row by row; null for any other length."""
    good = pixels.map(lambda x: x is not None and len(x) == SIDE * SIDE).to_numpy(dtype=bool)
    out = pd.DataFrame({"p": [None] * len(pixels), "a": [None] * len(pixels)}, dtype=object)
    if good.any():
        g = np.stack([np.asarray(x, float) for x in pixels[good]]).reshape(-1, SIDE, SIDE)
        means = g.reshape(-1, KEPT, 4, KEPT, 4).mean(axis=(2, 4)).reshape(-1, 64)
        dct = np.einsum("uy,nyx,vx->nuv", _COS, g, _COS).reshape(-1, 64)
        out.loc[good, "p"], out.loc[good, "a"] = _hex(dct), _hex(means)
    return out


def sniff(data: Column) -> Column:
    """The media type that a file's first bytes tell, else empty."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(F.coalesce(F.octet_length(data), F.lit(0)) < 12, "")
        .when(head.startswith("8950"), "image/png")
        .when(head.startswith("FFD8"), "image/jpeg")
        .when(head.startswith("4749"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(F.substring(head, 9, 16) == "6674797061766966", "image/avif")
        .otherwise("")
    )

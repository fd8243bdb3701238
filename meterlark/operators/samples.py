"""Down-sampling of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def downsample(points: DataFrame, keys: Sequence[str], x: str, y: str, threshold: int) -> DataFrame:
    """WIN11: at most ``threshold`` points of each series by largest triangles; each choice depends on the one before.

    A series is one report line (at most 90 days of five minutes), so a group is bounded.
    """
    names = [*keys, x, y]
    schema = points.select(*names).schema

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(x)
        n = len(pdf)
        if threshold < 3 or n <= threshold:
            return pdf[names]
        px, py = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        edges = np.floor(np.linspace(1, n - 1, threshold - 1)).astype(int)
        kept = [0]
        for i in range(threshold - 2):
            a, b = edges[i], max(edges[i + 1], edges[i] + 1)
            c = edges[i + 2] if i + 2 < len(edges) else n
            mx, my = (px[b:c].mean(), py[b:c].mean()) if c > b else (px[-1], py[-1])
            area = np.abs((px[kept[-1]] - mx) * (py[a:b] - py[kept[-1]]) - (px[kept[-1]] - px[a:b]) * (my - py[kept[-1]]))
            kept.append(a + int(area.argmax()))
        return pdf.iloc[[*kept, n - 1]][names]

    return points.select(*names).groupBy(*keys).applyInPandas(run, schema)

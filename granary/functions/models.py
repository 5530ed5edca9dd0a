"""The surface for opaque functions: detectors over images and pixel statistics. No model comes with the library; callers
give a loader, which runs once per task, and get Arrow batches fed to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: What a model gives for one image: (class, cx, cy, w, h, confidence) each.
Boxes = list[tuple[int, float, float, float, float, float]]
Model = Callable[[list[bytes]], list[Boxes]]
OUT = "img string, box_idx int, cls int, cx double, cy double, w double, h double, conf double"


def halving(model: Model, images: list[bytes], depth: int = 4) -> list[Boxes]:
    """The model on a batch; on a memory error, on its halves, up to `depth` times. A single image that still fails, or
    a batch that fails in another way, gives no boxes."""
    try:
        return model(images)
    except MemoryError:
        if depth == 0 or len(images) < 2:
            return [[] for _ in images]
        mid = len(images) // 2
        return halving(model, images[:mid], depth - 1) + halving(model, images[mid:], depth - 1)
    except Exception:  # one bad batch must not end the job; its images are left without boxes
        return [[] for _ in images]


def detect(images: DataFrame, load: Callable[[], Model], batch: int = 32, whole_image: bool = False) -> DataFrame:
    """Boxes of images (img, content). `load` makes the model, once per task. whole_image: an image without boxes gets
    one of class 0 over all of it, with confidence 0.1."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                own = pdf.iloc[at : at + batch]
                found = halving(model, [bytes(c) for c in own["content"]])
                rows = [
                    (img, k, int(c), *map(float, rest))
                    for img, boxes in zip(own["img"], found, strict=True)
                    for k, (c, *rest) in enumerate(boxes or ([(0, 0.5, 0.5, 1.0, 1.0, 0.1)] if whole_image else []))
                ]
                yield pd.DataFrame(rows, columns=["img", "box_idx", "cls", "cx", "cy", "w", "h", "conf"])

    return images.select("img", "content").mapInPandas(work, OUT)


def measure(images: DataFrame, function: Callable[[bytes], float | None], name: str) -> DataFrame:
    """img and a number per image, for instance a share of green pixels; null where the function gives none or fails."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(content: Any) -> float | None:
            try:
                return function(bytes(content))
            except Exception:  # unreadable images have no value
                return None

        for pdf in parts:
            yield pd.DataFrame({"img": pdf["img"], name: [one(c) for c in pdf["content"]]})

    return images.select("img", "content").mapInPandas(work, f"img string, `{name}` double")


def keep_measured(images: DataFrame, values: DataFrame, name: str, least: float) -> DataFrame:
    """Images whose value is there and at least `least`."""
    return images.join(values.filter(values[name] >= least).select("img"), "img", "left_semi")


class Toolbox:
    """Named DataFrame functions with counts and times of their calls."""

    def __init__(self) -> None:
        self.tools: dict[str, Callable[..., DataFrame]] = {}
        self.calls: dict[str, list[float]] = {}

    def register(self, name: str, function: Callable[..., DataFrame]) -> None:
        self.tools[name] = function

    def run(self, name: str, *args: Any, **more: Any) -> DataFrame:
        import time

        began = time.monotonic()
        try:
            return self.tools[name](*args, **more)
        finally:
            self.calls.setdefault(name, []).append(time.monotonic() - began)

    def stats(self) -> dict[str, tuple[int, float]]:
        return {name: (len(t), sum(t)) for name, t in self.calls.items()}

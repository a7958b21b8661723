"""Convolution kernels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..layout import require

MAX_SIDE = 7
MOST_KERNELS = 1024  # of one table


@dataclass(frozen=True)
class Kernel:
    """Odd square of weights; out = sum / divisor + bias, clamped."""

    name: str
    bias: int
    divisor: int
    rows: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(name: str, bias: int, divisor: int, text: str) -> Kernel:
        rows = tuple(tuple(int(v) for v in line.split()) for line in text.split("/"))
        side = len(rows)
        require(side % 2 == 1 and side <= MAX_SIDE, "kernels are 1, 3, 5 or 7 wide")
        require(all(len(r) == side for r in rows), "kernels are square")
        require(divisor != 0, "the divisor is not zero")
        require(any(any(r) for r in rows), "a kernel has a weight")
        return Kernel(name, bias, divisor, rows)

    def taps(self) -> list[tuple[int, int, int]]:
        """(dy, dx, weight) of the non-zero weights."""
        mid = len(self.rows) // 2
        return [
            (y - mid, x - mid, w)
            for y, row in enumerate(self.rows)
            for x, w in enumerate(row)
            if w
        ]


# The preset kernels as (name, bias, divisor, rows).
PRESETS = [
    ("average3", 0, 9, "1 1 1 / 1 1 1 / 1 1 1"),
    ("average5", 0, 25, "1 1 1 1 1 / 1 1 1 1 1 / 1 1 1 1 1 / 1 1 1 1 1 / 1 1 1 1 1"),
    (
        "average7",
        0,
        49,
        "1 1 1 1 1 1 1 / 1 1 1 1 1 1 1 / 1 1 1 1 1 1 1 / 1 1 1 1 1 1 1 /"
        "1 1 1 1 1 1 1 / 1 1 1 1 1 1 1 / 1 1 1 1 1 1 1",
    ),
    ("gauss4", 0, 6, "0 1 0 / 1 2 1 / 0 1 0"),
    ("gauss8", 0, 16, "1 2 1 / 2 4 2 / 1 2 1"),
    ("roberts1", 200, 1, "0 0 0 / 0 1 0 / 0 0 -1"),
    ("roberts2", 200, 1, "0 0 0 / 0 1 0 / -1 0 0"),
    ("laplace4", 128, 1, "0 1 0 / 1 -4 1 / 0 1 0"),
    ("laplace8", 128, 1, "1 1 1 / 1 -8 1 / 1 1 1"),
    ("prewitt1", 0, 6, "1 1 1 / 0 0 0 / 1 1 1"),
    ("prewitt2", 0, 6, "1 0 1 / 1 0 1 / 1 0 1"),
    ("sobel1", 128, 8, "1 2 1 / 0 0 0 / -1 -2 -1"),
    ("sobel2", 128, 8, "-1 0 1 / -2 0 2 / -1 0 1"),
    ("kirsch1", 0, 1, "3 3 3 / 3 0 3 / -5 -5 -5"),
    ("kirsch2", 0, 1, "-5 3 3 / -5 0 3 / -5 3 3"),
]

# The kernels of the extra library, same form.
LIBRARY = [
    ("basrelief_hard", 0, 1, "-6 1 -1 / 1 -1 1 / -1 1 6"),
    ("basrelief_soft", 0, 2, "-1 0 0 0 0 / 0 -4 2 -2 0 / 0 2 -2 2 0 / 0 -2 2 4 0 / 0 0 0 0 1"),
    ("blur_grainy", 0, 16, "8 -8 8 / -8 16 -8 / 8 -8 8"),
    ("emboss", 0, 1, "-1 -1 0 / -1 0 1 / 0 1 1"),
    ("emboss_soft", 0, 9, "0 0 0 0 0 / 0 -1 -1 -1 0 / 0 -1 -1 -1 0 / 0 -1 -1 -1 2 / 0 0 0 2 5"),
    ("enhance", 0, 1, "1 1 0 / 1 1 -1 / 0 -1 -1"),
    ("focus", 0, 2, "-1 0 -1 / 0 6 0 / -1 0 -1"),
    ("grain", 0, 2, "0 -3 2 / -3 10 -3 / 2 -3 0"),
    ("offset", 0, 1, "1 0 0 / 0 -1 0 / 0 0 1"),
    ("outline", 300, 2, "-4 -4 -4 -4 -4 / -4 8 8 8 -4 / -4 8 0 8 -4 / -4 8 8 8 -4 / -4 -4 -4 -4 -4"),
    ("outline_thin", 204, 4, "-4 -4 -4 / -4 32 -4 / -4 -4 -4"),
    ("rise", 0, 1, "2 1 0 / 1 1 -1 / 0 -1 -2"),
]


def preset(name: str) -> Kernel:
    for entry in PRESETS + LIBRARY:
        if entry[0] == name:
            return Kernel.of(*entry)
    raise KeyError(name)


def load_kernels(spark: SparkSession, path: str) -> DataFrame:
    """Kernel files to (name, bias, divisor, dy, dx, w), non-zero weights only.

    A file has comment lines starting with ';', then size, bias and divisor on
    lines of their own, then seven lines of seven weights.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_name"), r"\."), 1).alias("name"), "value"
    )
    lines = F.filter(
        F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)),
        lambda s: (F.length(s) > 0) & ~s.startswith(";"),
    )
    parsed = text.select("name", lines.alias("lines")).select(
        "name",
        F.get("lines", F.lit(1)).cast("int").alias("bias"),
        F.get("lines", F.lit(2)).cast("int").alias("divisor"),
        F.posexplode(F.slice("lines", 4, MAX_SIDE)).alias("i", "line"),
    )
    cells = parsed.select(
        "name",
        "bias",
        "divisor",
        (F.col("i") - MAX_SIDE // 2).alias("dy"),
        F.posexplode(F.split("line", r"\s+")).alias("j", "v"),
    )
    return cells.select(
        "name",
        "bias",
        "divisor",
        "dy",
        (F.col("j") - MAX_SIDE // 2).alias("dx"),
        F.col("v").cast("int").alias("w"),
    ).where(F.col("w") != 0)


def collect_kernels(table: DataFrame) -> list[Kernel]:
    """Kernel rows to objects: at most MOST_KERNELS of up to 49 rows each."""
    rows = table.limit(MOST_KERNELS * MAX_SIDE**2 + 1).collect()
    require(len(rows) <= MOST_KERNELS * MAX_SIDE**2, "too many kernels")
    grouped: dict[str, list] = {}
    for row in rows:
        grouped.setdefault(row["name"], []).append(row)
    kernels = []
    for name, rows in sorted(grouped.items()):
        weights = [[0] * MAX_SIDE for _ in range(MAX_SIDE)]
        for row in rows:
            weights[row["dy"] + MAX_SIDE // 2][row["dx"] + MAX_SIDE // 2] = row["w"]
        kernels.append(
            Kernel(name, rows[0]["bias"], rows[0]["divisor"], tuple(map(tuple, weights)))
        )
    return kernels

"""samplers as table functions, callable from SQL.

    SELECT * FROM sample_frames(TABLE(SELECT video_id, frame_idx, total_frames FROM frames), 8, 'uniform')

The table argument is partitioned by the function itself: by video and span of frame indexes, so that a long video is
many partitions. A row says how many frames its video has, so rows are judged one by one and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

SPAN = 1 << 16
RULES = ("uniform", "midpoint", "linspace")


def sample_index(rule: str, n: int, i: int, total: int) -> int:
    """The frame of sample position i, in the doubles that the rules are written in."""
    if n == 1:
        return total // 2 if rule == "midpoint" else 0
    if rule == "midpoint":
        return min(max(int((i + 0.5) / float(n) * total), 0), total - 1)
    if rule == "linspace":
        return total - 1 if i == n - 1 else int(i * ((total - 1) / float(n - 1)))
    return int(i / float(n - 1) * (total - 1))


@udtf
class SampleFrames:
    """Rows of a frame table (video_id, frame_idx, total_frames and any other columns) that a sampling rule picks, with sample_pos.
    Arguments: the table, the number of samples, the rule."""

    def __init__(self):
        self.picks: dict[int, dict[int, list[int]]] = {}  # by total_frames: frame -> sample positions

    @staticmethod
    def analyze(frames: AnalyzeArgument, n: AnalyzeArgument, rule: AnalyzeArgument) -> AnalyzeResult:
        if not frames.isTable or not {"video_id", "frame_idx", "total_frames"} <= set(frames.dataType.names):
            raise ValueError("the first argument is a table with video_id, frame_idx and total_frames")
        if not isinstance(n.value, int) or rule.value not in RULES:
            raise ValueError(f"the others are a number of samples and one of {', '.join(RULES)}")
        return AnalyzeResult(StructType([*frames.dataType.fields]).add("sample_pos", LongType()),
                             partitionBy=[PartitioningColumn("video_id"), PartitioningColumn(f"frame_idx div {SPAN}")],
                             orderBy=[OrderingColumn("frame_idx")])

    def eval(self, frame: Row, n: int, rule: str) -> Iterator[tuple]:
        total = frame["total_frames"]
        if total is None or frame["frame_idx"] is None:
            return
        if total not in self.picks:
            self.picks = {total: {}}  # one video's rows come together
            for i in range(n):
                self.picks[total].setdefault(sample_index(rule, n, i, total), []).append(i)
        for i in self.picks[total].get(frame["frame_idx"], ()):
            yield *frame, i


def register(spark: SparkSession) -> None:
    """Make ``sample_frames`` known to SQL."""
    spark.udtf.register("sample_frames", SampleFrames)

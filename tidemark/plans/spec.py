"""What a snapshot looks like: columns, their classes, legal values and the roles of some."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StringType, StructField, StructType

#: Highest integer that readers in double precision keep exactly.
MAX_INT = 2**53 - 1
#: Closed number buckets (label, low, high; None: open).
ENROLL_BUCKETS = (("0", 0, 0), ("1-10", 1, 10), ("11-30", 11, 30), ("31-100", 31, 100), ("101+", 101, None))
#: Marks of what has no value.
UNPROVIDED, CONFLICTED = "__unprovided__", "__conflicted__"


@dataclass(frozen=True)
class SnapshotSpec:
    """Column classes are disjoint; presentation columns are those that entities resolve."""

    columns: tuple[str, ...]
    identity: str
    updated: str
    categorical: dict[str, tuple[str, ...]] = field(default_factory=dict)
    numeric: tuple[str, ...] = ()
    period_start: str | None = None
    period_end: str | None = None
    hidden: tuple[str, ...] = ()
    long_text: tuple[str, ...] = ()
    short_search: tuple[str, ...] = ()
    long_search: tuple[str, ...] = ()
    facets: dict[str, str] = field(default_factory=dict)
    folded_facets: tuple[str, ...] = ()
    applicant: str | None = None
    title: str | None = None
    test_marks: tuple[str, ...] = ()

    @property
    def presentation(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in (self.identity, self.updated, *self.hidden))

    @property
    def period(self) -> tuple[str, ...]:
        return tuple(c for c in (self.period_start, self.period_end) if c)

    @property
    def text(self) -> tuple[str, ...]:
        return tuple(c for c in self.presentation if self.kind(c) == "text")

    @property
    def card(self) -> tuple[str, ...]:
        return tuple(c for c in self.presentation if c not in self.long_text)

    def kind(self, column: str) -> str:
        if column in self.categorical:
            return "categorical"
        return "numeric" if column in self.numeric else "period" if column in self.period else "text"

    @property
    def schema(self) -> StructType:
        return StructType([StructField(c, StringType(), False) for c in self.columns])

    def __post_init__(self) -> None:
        known = set(self.columns)
        named = {self.identity, self.updated, *self.categorical, *self.numeric, *self.period, *self.hidden, *self.long_text, *self.short_search, *self.long_search, *self.facets.values()}
        if len(known) != len(self.columns) or not named <= known:
            raise ValueError(f"columns that are not in the snapshot, or twice: {sorted(named - known)}")
        if not set(self.long_text) <= set(self.presentation):
            raise ValueError("long text columns must be presentation columns")


# Fixed values of the clinical-trial profile: column names in source order, legal values, marks of test rows.
TRIALS = SnapshotSpec(
    columns=(
        "臨床試驗申請者", "臨床試驗計畫書編號", "臨床試驗計畫中文名稱", "臨床試驗期別", "本臨床試驗規模", "試驗目的", "試驗預計執行期間起", "試驗預計執行期間迄",
        "全球預計受試者人數", "台灣預計受試者人數", "適應症中文", "主要評估指標", "納入條件", "排除條件", "TFDA收文號", "資料更新時間",
    ),
    identity="臨床試驗計畫書編號",
    updated="資料更新時間",
    categorical={
        "臨床試驗期別": ("Phase Ⅰ", "Phase Ⅱ", "Phase Ⅲ", "Phase Ⅳ", "Phase Ⅰ,Phase Ⅱ", "Phase Ⅱ,Phase Ⅲ", "其他"),
        "本臨床試驗規模": ("多國多中心", "台灣單中心", "台灣多中心"),
    },
    numeric=("全球預計受試者人數", "台灣預計受試者人數"),
    period_start="試驗預計執行期間起",
    period_end="試驗預計執行期間迄",
    hidden=("TFDA收文號",),
    long_text=("試驗目的", "主要評估指標", "納入條件", "排除條件"),
    short_search=("臨床試驗計畫書編號", "臨床試驗計畫中文名稱", "臨床試驗申請者", "適應症中文", "TFDA收文號"),
    long_search=("試驗目的", "主要評估指標"),
    facets={"phase": "臨床試驗期別", "scale": "本臨床試驗規模", "applicant": "臨床試驗申請者"},
    folded_facets=("臨床試驗申請者",),
    applicant="臨床試驗申請者",
    title="臨床試驗計畫中文名稱",
    test_marks=("系統測試", "計畫書編號"),
)

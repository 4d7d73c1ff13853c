"""Announcement messages and the sorted sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.roles import announceable, in_us, role_rank
from jobloom.functions.text import text
from jobloom.operators.ranking import global_row_number
from jobloom.operators.skew import HOT_ROWS, join_unique
from jobloom.settings import MESSAGE_SIZE

# Sheet columns in order, card colours and card texts.
SHEET_COLS = (
    "first_seen", "company", "title", "role_type", "location", "posted_on",
    "source", "apply_url", "job_id", "sponsorship", "clearance", "grad_year",
)
SHEET_FORMAT = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False, "multiLine": True,
}
ROLE_COLORS = {"intern": 0x2ECC71, "new_grad": 0x3498DB, "mid": 0xF1C40F, "senior": 0xE74C3C}
OTHER_COLOR = 0x95A5A6
EMPTY = "—"
SPONSORSHIP_TEXT = {"no": "❌ Not offered", "yes": "✅ Offered"}
CLEARANCE_TEXT = "🔒 Required"


def sheet_rows(jobs: DataFrame) -> DataFrame:
    return jobs.select(*[text(F.col(c)).alias(c) for c in SHEET_COLS])


def to_announce(jobs: DataFrame) -> DataFrame:
    return jobs.where(announceable(F.col("role_type")) & in_us(F.col("location")))


def announce_counts(jobs: DataFrame) -> DataFrame:
    posts = announceable(F.col("role_type")) & in_us(F.col("location"))
    return jobs.agg(
        F.count_if(posts).alias("posted"), F.count_if(~posts).alias("filtered_out")
    )


def _field(name: str, value: Column, show: Column | None = None) -> Column:
    made = F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(True).alias("inline"))
    return made if show is None else F.when(show, made)


def card(title_limit: int | None = None) -> Column:
    """Announcement card of a job row: title, url, color and the fields that apply.

    ``title_limit`` cuts the title for services that refuse longer ones.
    """
    def set_(name: str) -> Column:
        return text(F.col(name)) != ""

    def or_dash(name: str) -> Column:
        return F.when(set_(name), F.col(name)).otherwise(EMPTY)

    sponsor = F.coalesce(
        *[F.when(F.col("sponsorship") == k, F.lit(v)) for k, v in SPONSORSHIP_TEXT.items()]
    )
    color = F.coalesce(
        *[F.when(F.col("role_type") == k, F.lit(v)) for k, v in ROLE_COLORS.items()],
        F.lit(OTHER_COLOR),
    )
    fields = F.array_compact(
        F.array(
            _field("Company", or_dash("company")),
            _field("Role", F.col("role_type")),
            _field("Location", or_dash("location")),
            _field("Posted", F.col("posted_on"), set_("posted_on")),
            _field("Sponsorship", sponsor, sponsor.isNotNull()),
            _field("Clearance", F.lit(CLEARANCE_TEXT), set_("clearance")),
            _field("Grad year", F.col("grad_year"), set_("grad_year")),
        )
    )
    return F.struct(
        (F.col("title") if title_limit is None else F.substring("title", 1, title_limit)).alias("title"),
        F.col("apply_url").alias("url"),
        color.alias("color"),
        fields.alias("fields"),
    )


def messages(
    jobs: DataFrame, size: int = MESSAGE_SIZE, title_limit: int | None = None
) -> DataFrame:
    """(message_no, cards): the jobs to announce, in batch order, ``size`` to a message."""
    cards = to_announce(jobs).select("seq", card(title_limit).alias("card"))
    placed = global_row_number(cards, "seq", "pos")
    number = F.floor((F.col("pos") - 1) / size).cast("bigint").alias("message_no")
    # At most ``size`` rows meet in one group.
    grouped = placed.groupBy(number).agg(
        F.array_sort(F.collect_list(F.struct("pos", "card"))).alias("placed")
    )
    return grouped.select("message_no", F.col("placed.card").alias("cards"))


def payloads(batches: DataFrame) -> DataFrame:
    """(message_no, payload): each message as the JSON a chat webhook takes."""
    body = F.to_json(F.struct(F.col("cards").alias("embeds")))
    return batches.select("message_no", body.alias("payload"))


def write_messages(batches: DataFrame, path: str) -> None:
    """One JSON line per message, files sorted by message number."""
    payloads(batches).orderBy("message_no").select("payload").write.text(path)


def write_sheet(sheet: DataFrame, path: str) -> None:
    """The sorted sheet as CSV with a header; part files follow the order.

    Cells keep their blanks, and quotes are doubled, as spreadsheets do.
    """
    rows = sheet_sorted(sheet).select(*SHEET_COLS)
    rows.write.options(**SHEET_FORMAT).option("emptyValue", "").csv(path)


def sheet_append(
    sheet: DataFrame, jobs: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows of ``jobs`` (with ``append_seq``) whose id the sheet lacks.

    An empty id is always appended, and so are repeats inside one payload.
    """
    ids = sheet.where(text(F.col("job_id")) != "").select("job_id")
    return join_unique(
        jobs, ids, ["job_id"], "left_anti", "append_seq", hot_rows, reduce=[]
    )


def sheet_sorted(sheet: DataFrame) -> DataFrame:
    """Role order, then most recent first, then order of arrival."""
    return sheet.orderBy(
        role_rank(F.col("role_type")), text(F.col("first_seen")).desc(), "append_seq"
    )


def sheet_positions(sheet: DataFrame) -> DataFrame:
    """Rows with ``position``, their line in the sorted sheet, 1 for the first."""
    keyed = sheet.withColumns({
        "_role": role_rank(F.col("role_type")), "_seen": text(F.col("first_seen")),
    })
    order = [F.col("_role").asc(), F.col("_seen").desc(), F.col("append_seq").asc()]
    return global_row_number(keyed, order, "position").drop("_role", "_seen")

"""Row shapes shared by every module.

All text columns are strings, timestamps included; an empty string means
"unknown" and only ``location`` may be NULL. ``seq`` may be any unique number that gives the
order; batches built here have a DECIMAL(38,0).
"""

POSTING = (
    "seq BIGINT, job_id STRING, company STRING, title STRING, apply_url STRING, "
    "location STRING, posted_on STRING, source STRING, description STRING"
)
JOB_STATE = (
    "job_id STRING, company STRING, title STRING, apply_url STRING, location STRING, "
    "role_type STRING, posted_on STRING, source STRING, sponsorship STRING, "
    "clearance STRING, grad_year STRING, first_seen STRING, last_seen STRING, status STRING"
)
RAW_PAGE = (
    "ats STRING, board STRING, term STRING, term_ord INT, board_ord INT, "
    "page_no BIGINT, status INT, body STRING"
)
BOARD = (
    "ats STRING, board_key STRING, tenant STRING, wd STRING, site STRING, "
    "slug STRING, name STRING, ord BIGINT"
)
CANDIDATE = (
    "ats STRING, board_key STRING, tenant STRING, wd STRING, site STRING, "
    "slug STRING, name STRING, origin STRING, seq DECIMAL(38,0)"
)
PROBE = "ats STRING, board_key STRING, status INT, body STRING"
DETAIL = "source STRING, detail_key STRING, status INT, body STRING"


def names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


POSTING_COLS = names(POSTING)
STATE_COLS = names(JOB_STATE)
BOARD_COLS = names(BOARD)
CANDIDATE_COLS = names(CANDIDATE)

# Columns an older state may lack, with their defaults.
STATE_DEFAULTS = {
    "posted_on": "",
    "source": "workday",
    "sponsorship": "",
    "clearance": "",
    "grad_year": "",
}

# Role types, in sheet order.
ROLE_TYPES = ("intern", "new_grad", "mid", "senior")
ANNOUNCE_ROLES = ("intern", "new_grad")
DEFAULT_ROLE = "mid"

# The order in which the sources of one run are concatenated.
SOURCE_ORDER = (
    "workday",
    "greenhouse",
    "lever",
    "ashby",
    "smartrecruiters",
    "workable",
    "aggregator",
)

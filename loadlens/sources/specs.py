"""Declared source schemas: which columns are numbers, texts, times.

Every column is optional: rules apply only to columns present in the file,
and undeclared columns pass through as read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from loadlens.functions.cleaning import DEFAULT_TEXT


@dataclass(frozen=True)
class SourceSpec:
    name: str
    numeric: tuple[str, ...] = ()
    # text column -> placeholder for missing text
    text: dict[str, str] = field(default_factory=dict)
    # compact date + time columns combined into ``datetime_col``
    date_time: tuple[str, str] | None = None
    datetime_col: str = "FULL_DATETIME"
    # rows with a null in any of these (present) columns are dropped
    required: tuple[str, ...] = ()
    # texts cleaned only after the null drop (so missing text drops the row)
    clean_after_drop: bool = False
    # number notation of text numbers: "plain" or "eu" (1.234,5)
    number_style: str = "plain"
    # MM:SS duration column -> seconds column
    duration: tuple[str, str] | None = None
    # numeric columns added as 0.0 when absent
    default_zero: tuple[str, ...] = ()
    # compact yyyyMMdd date column -> date column (null when absent)
    compact_date: tuple[str, str] | None = None


# --- fixed values: column lists of the eight workload exports --------------------
MEMORY_NUMERIC = ("MEMSUM", "PRIVSUM", "USEDBYTES", "MAXBYTES", "MAXBYTESDI", "PRIVCOUNT", "RESTCOUNT", "COUNTER")

HITLIST_NUMERIC = (
    "GENERATETI", "REPLOADTI", "CUALOADTI", "DYNPLOADTI", "QUETI", "DDICTI", "CPICTI",
    "LOCKCNT", "LOCKTI", "BTCSTEPNR", "RESPTI", "PROCTI", "CPUTI", "QUEUETI", "ROLLWAITTI",
    "GUITIME", "GUICNT", "GUINETTIME", "DBP_COUNT", "DBP_TIME", "DSQLCNT", "QUECNT",
    "CPICCNT", "SLI_CNT", "TAB1DIRCNT", "TAB1SEQCNT", "TAB1UPDCNT", "TAB2DIRCNT",
    "TAB2SEQCNT", "TAB2UPDCNT", "TAB3DIRCNT", "TAB3SEQCNT", "TAB3UPDCNT", "TAB4DIRCNT",
    "TAB4SEQCNT", "TAB4UPDCNT", "TAB5DIRCNT", "TAB5SEQCNT", "TAB5UPDCNT",
    "READDIRCNT", "READDIRTI", "READDIRBUF", "READDIRREC", "READSEQCNT", "READSEQTI",
    "READSEQBUF", "READSEQREC", "PHYREADCNT", "INSCNT", "INSTI", "INSREC", "PHYINSCNT",
    "UPDCNT", "UPDTI", "UPDREC", "PHYUPDCNT", "DELCNT", "DELTI", "DELREC", "PHYDELCNT",
    "DBCALLS", "COMMITTI", "INPUTLEN", "OUTPUTLEN", "MAXROLL", "MAXPAGE",
    "ROLLINCNT", "ROLLINTI", "ROLLOUTCNT", "ROLLOUTTI", "ROLLED_OUT", "PRIVSUM",
    "USEDBYTES", "MAXBYTES", "MAXBYTESDI", "RFCRECEIVE", "RFCSEND",
    "RFCEXETIME", "RFCCALLTIM", "RFCCALLS", "VMC_CALL_COUNT", "VMC_CPU_TIME", "VMC_ELAP_TIME",
)

TIMES_NUMERIC = (
    "COUNT", "LUW_COUNT", "RESPTI", "PROCTI", "CPUTI", "QUEUETI", "ROLLWAITTI",
    "GUITIME", "GUICNT", "GUINETTIME", "DBP_COUNT", "DBP_TIME", "READDIRCNT",
    "READDIRTI", "READDIRBUF", "READDIRREC", "READSEQCNT", "READSEQTI",
    "READSEQBUF", "READSEQREC", "CHNGCNT", "CHNGTI", "CHNGREC", "PHYREADCNT",
    "PHYCHNGREC", "PHYCALLS", "VMC_CALL_COUNT", "VMC_CPU_TIME", "VMC_ELAP_TIME",
)

TASKTIMES_NUMERIC = (
    "COUNT", "RESPTI", "PROCTI", "CPUTI", "QUEUETI", "ROLLWAITTI", "GUITIME",
    "GUICNT", "GUINETTIME", "DBP_COUNT", "DBP_TIME", "READDIRCNT", "READDIRTI",
    "READDIRBUF", "READDIRREC", "READSEQCNT", "READSEQTI",
    "READSEQBUF", "READSEQREC", "CHNGCNT", "CHNGTI", "CHNGREC", "PHYREADCNT",
    "PHYCHNGREC", "PHYCALLS", "CNT001", "CNT002", "CNT003", "CNT004", "CNT005", "CNT006", "CNT007", "CNT008",
    "CNT009",
)

USERTCODE_NUMERIC = (
    "COUNT", "DCOUNT", "UCOUNT", "BCOUNT", "ECOUNT", "SCOUNT", "LUW_COUNT",
    "TMBYTESIN", "TMBYTESOUT", "RESPTI", "PROCTI", "CPUTI", "QUEUETI",
    "ROLLWAITTI", "GUITIME", "GUICNT", "GUINETTIME", "DBP_COUNT", "DBP_TIME",
    "READDIRCNT", "READDIRTI", "READDIRBUF", "READDIRREC", "READSEQCNT",
    "READSEQTI", "READSEQBUF", "READSEQREC", "CHNGCNT", "CHNGTI", "CHNGREC",
    "PHYREADCNT", "PHYCHNGREC", "PHYCALLS", "DSQLCNT", "QUECNT", "CPICCNT",
    "SLI_CNT", "VMC_CALL_COUNT", "VMC_CPU_TIME", "VMC_ELAP_TIME",
)

PERFORMANCE_NUMERIC = ("WP_IWAIT", "WP_NO", "WP_IRESTRT", "WP_PID", "WP_INDEX")
PERFORMANCE_TEXT = ("WP_SEMSTAT", "WP_IACTION", "WP_ITYPE", "WP_RESTART", "WP_ISTATUS", "WP_TYP", "WP_STATUS")

SQL_TRACE_NUMERIC = ("TOTALEXEC", "IDENTSEL", "EXECTIME", "RECPROCNUM", "TIMEPEREXE", "RECPEREXE", "AVGTPERREC",
                     "MINTPERREC")

MEMORY_ACCOUNT_DEFAULT = "Compte Inconnu"
MEMORY_MANDT_DEFAULT = "MANDT Inconnu"
# ----------------------------------------------------------------------------------


def _texts(names, default=DEFAULT_TEXT) -> dict[str, str]:
    return {n: default for n in names}


CATALOG: dict[str, SourceSpec] = {
    "memory": SourceSpec(
        "memory", MEMORY_NUMERIC,
        {"ACCOUNT": MEMORY_ACCOUNT_DEFAULT, "MANDT": MEMORY_MANDT_DEFAULT},
        date_time=("ENDDATE", "ENDTIME"), required=("USEDBYTES", "ACCOUNT")),
    "hitlist_db": SourceSpec(
        "hitlist_db", HITLIST_NUMERIC,
        _texts(("WPID", "ACCOUNT", "REPORT", "ROLLKEY", "PRIVMODE", "WPRESTART")),
        date_time=("ENDDATE", "ENDTIME"), required=("RESPTI", "PROCTI", "CPUTI", "DBCALLS", "FULL_DATETIME")),
    "times": SourceSpec(
        "times", TIMES_NUMERIC, _texts(("TIME", "ENTRY_ID")), required=("RESPTI", "PHYCALLS", "COUNT")),
    "tasktimes": SourceSpec(
        "tasktimes", TASKTIMES_NUMERIC, _texts(("TIME",)), required=("COUNT", "RESPTI", "CPUTI")),
    "usertcode": SourceSpec(
        "usertcode", USERTCODE_NUMERIC, _texts(("ENTRY_ID", "ACCOUNT")),
        date_time=("ENDDATE", "ENDTIME"), required=("RESPTI", "ACCOUNT", "COUNT"), clean_after_drop=True),
    "performance": SourceSpec(
        "performance", PERFORMANCE_NUMERIC, _texts(PERFORMANCE_TEXT),
        duration=("WP_CPU", "WP_CPU_SECONDS"), default_zero=("WP_IWAIT",),
        required=("WP_CPU_SECONDS", "WP_STATUS")),
    "sql_trace_summary": SourceSpec(
        "sql_trace_summary", SQL_TRACE_NUMERIC, _texts(("SQLSTATEM", "SERVERNAME", "TRANS_ID")),
        number_style="eu", required=("EXECTIME", "TOTALEXEC", "SQLSTATEM")),
    "usr02": SourceSpec(
        "usr02", (), _texts(("BNAME", "USTYP")), compact_date=("GLTGB", "GLTGB_DATE")),
}

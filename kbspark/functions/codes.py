"""Status codes, messages and ids as expressions."""

from pyspark.sql import Column, functions as F

from kbspark import fixed_values as fv


def status_text(status: Column) -> Column:
    text = F.lit("unknown")
    for code, name in fv.STATUS_TEXT.items():
        text = F.when(status == code, name).otherwise(text)
    return text


def task_status(total: Column, success: Column, failed: Column, skipped: Column) -> Column:
    return (F.when(total == 0, fv.STATUS_FAILED)
            .when(failed == 0, fv.STATUS_SUCCESS)
            .when((success > 0) | (skipped > 0), fv.STATUS_PARTIAL)
            .otherwise(fv.STATUS_FAILED))


def task_message(total: Column, success: Column, failed: Column, skipped: Column) -> Column:
    return (F.when(total == 0, fv.NO_CHUNKS_MESSAGE)
            .when(failed == 0, F.lit(None).cast("string"))
            .when((success > 0) | (skipped > 0), fv.SOME_FAILED_MESSAGE)
            .otherwise(fv.ALL_FAILED_MESSAGE))


def run_status(success: Column, failed: Column) -> Column:
    return (F.when(failed == 0, fv.STATUS_SUCCESS)
            .when(success > 0, fv.STATUS_PARTIAL)
            .otherwise(fv.STATUS_FAILED))


def vector_id(chunk_id: Column) -> Column:
    """Name-based (MD5, version 3) UUID of the chunk's vector."""
    digest = F.md5(F.concat(F.lit(fv.VECTOR_ID_PREFIX), chunk_id.cast("string")))
    # The variant's two top bits are 10: digit 0-f maps to 8, 9, a, b by its low two bits.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def retrieval_mode(mode: Column) -> Column:
    """Known modes in upper case; blank or unknown text means vector search."""
    from kbspark.functions.text import trimmed

    name = F.upper(trimmed(mode))
    return F.when(name.isin(*fv.MODES), name).otherwise(fv.MODES[0])

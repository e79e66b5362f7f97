"""URI functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import letters_and_digits, strip_space


def site(domain: Column) -> Column:
    """The host in a domain's spelling: lower case, no blanks, scheme, ``www.``, port, trailing dot or slash; null if none is left."""
    host = F.lower(strip_space(domain))
    host = F.regexp_replace(host, r"^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(host, r"[/?#].*$", "")
    host = F.regexp_replace(host, r"(:\d*|\.)+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def uri_host(uri: Column) -> Column:
    """The site of an absolute URI, null where there is no authority."""
    return site(F.regexp_extract(strip_space(uri), r"(?i)^[a-z][a-z0-9+.\-]*:/+([^/?#]*)", 1))


def percent_decode(text: Column) -> Column:
    """Percent-escapes decoded as UTF-8; a ``%`` that starts no escape and every ``+`` stay as they are."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%"), F.url_decode(safe)).otherwise(text)


def address_path_key(decoded: Column) -> Column:
    """Letters and digits of what stands before the first ``?``."""
    return letters_and_digits(F.substring_index(decoded, "?", 1))


def address_parameter_key(decoded: Column) -> Column:
    """The parameters after the first ``?``, each reduced to letters and digits, empty ones dropped, in sorted order."""
    query = F.when(F.instr(decoded, "?") > 0, F.regexp_replace(decoded, r"(?s)^[^?]*\?", "")).otherwise(F.lit(""))
    # the reduction keeps & as the separator, so one pass serves all the parameters
    cut = F.split(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}&]+", ""), "&")
    return F.array_join(F.sort_array(F.filter(cut, lambda p: p != "")), "&")

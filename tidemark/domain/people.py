"""Owners of filings: readable names, roles, entities, executives by fiscal year, insider transactions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import col
from tidemark.operators.joins import interval_join

# Roles in order with their title patterns, and name particles and suffixes.
ROLES = (("CEO", r"CHIEF EXECUTIVE|\bCEO\b|PRINCIPAL EXECUTIVE"), ("CFO", r"CHIEF FINANCIAL|\bCFO\b|PRINCIPAL FINANCIAL"), ("COO", r"CHIEF OPERATING|\bCOO\b"),
         ("President", r"(?<!VICE )(?<!VICE-)\bPRESIDENT\b"), ("Chair", r"\bCHAIR"), ("General Counsel", r"GENERAL COUNSEL|CHIEF LEGAL|\bGC\b"))
ROLE_ORDER = ("CEO", "CFO", "COO", "President", "Chair", "General Counsel", "Director", "Other")
COMPANY_WIDE = ("CEO", "CFO", "COO", "President")
SUFFIXES = ("JR", "SR", "II", "III", "IV", "V", "MD", "PHD", "ESQ")
PARTICLES = ("VAN", "VON", "DE", "DER", "DEN", "TER", "TEN", "DI", "DA", "DEL", "DELLA", "LA", "LE", "ST", "DU", "DOS", "DAS")
#: Words of offices and boards; any other word after a role names a part of the company.
OFFICE_WORDS = ("A", "ACTING", "AND", "BOARD", "CEO", "CFO", "CHAIR", "CHAIRMAN", "CHAIRPERSON", "CHAIRWOMAN", "CHIEF", "COMPANY", "COO", "COUNSEL", "DIRECTOR", "EXECUTIVE", "FINANCIAL", "FOUNDER",
                "GENERAL", "INTERIM", "MEMBER", "OF", "OFFICER", "OPERATING", "PRESIDENT", "SECRETARY", "THE", "TREASURER")
#: Company types that end a name, and words that people's names don't have.
ENTITY_ENDS = ("AG", "BANK", "BV", "CO", "CORP", "CORPORATION", "FOUNDATION", "FUNDS", "GMBH", "GROUP", "HOLDING", "INC", "INCORPORATED", "LIMITED", "LLC", "LLP", "LP", "LTD", "NA", "NV", "PLC", "SA", "ADVISORS", "VENTURES", "INVESTMENTS")
ENTITY_WORDS = ("CAPITAL", "FUND", "HOLDINGS", "LLC", "LP", "MANAGEMENT", "PARTNERS", "PARTNERSHIP", "TRUST")


def is_entity(name) -> Column:
    """The last word is a company type, or any word is one that only companies and funds have; dots don't count."""
    words = F.filter(F.split(F.regexp_replace(F.upper(col(name)), r"[.']", ""), "[^A-Z0-9]+"), lambda w: w != "")
    return F.coalesce(F.exists(words, lambda w: w.isin(*ENTITY_WORDS)) | F.try_element_at(words, F.lit(-1)).isin(*ENTITY_ENDS), F.lit(False))


def role_of(title, officer, director) -> Column:
    """The first role whose pattern the title has; a company-wide role counts only if nothing but words of offices follow it."""
    t = F.upper(F.coalesce(col(title), F.lit("")))
    out = F.when(col(officer), "Other").when(col(director), "Director").otherwise("Other")
    for role, pattern in reversed(ROLES):
        hit = t.rlike(pattern)
        if role in COMPANY_WIDE:
            after = F.split(F.element_at(F.split(t, pattern), -1), "[^A-Z]+")
            shared = t.rlike(r"\bCO[- ]?(" + pattern.replace(r"\b", "") + ")")
            hit = hit & ~shared & (F.size(F.array_except(after, F.array(*[F.lit(w) for w in ("", *OFFICE_WORDS)]))) == 0)
        out = F.when(hit, role).otherwise(out)
    return out


def _styled(word: Column) -> Column:
    """One word of a name: each part of a hyphenated word begins large, and so does what follows Mc, O' and D'."""
    parts = F.transform(F.split(word, "-"), lambda p: F.initcap(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^(Mc|O'|D')."), F.concat(F.substring(p, 1, 2), F.upper(F.substring(p, 3, 1)), F.substring(p, 4, 99))).otherwise(p)), "-")


def readable_name(name) -> Column:
    """'LAST FIRST MIDDLE SUFFIX' as 'First M. Last Suffix', by expressions over the array of its words.

    The family name is the first word, or leading particles (kept small) and the word after them if one more is left. One letter
    gets a dot; so does a suffix of up to three letters that isn't a numeral. Blank names stay as they are, null is null.
    """
    words = F.filter(F.split(F.regexp_replace(col(name), "[,.]", " "), r"\s+"), lambda w: w != "")
    is_suffix = lambda w, i: (i > 0) & F.upper(w).isin(*SUFFIXES)
    core, tail = F.filter(words, lambda w, i: ~is_suffix(w, i)), F.filter(words, is_suffix)
    plain_at = F.array_position(F.transform(core, lambda w: F.upper(w).isin(*PARTICLES)), F.lit(False)).cast("int")  # 1: no leading particle
    leading = F.greatest(F.least(F.when(plain_at == 0, F.size(core)).otherwise(plain_at - 1), F.size(core) - 2), F.lit(0))
    family = F.concat(F.transform(F.slice(core, 1, leading), F.lower), F.transform(F.slice(core, leading + 1, 1), _styled))
    given = F.transform(F.slice(core, leading + 2, F.size(core)), lambda w: F.when(F.length(w) == 1, F.concat(F.upper(w), F.lit("."))).otherwise(_styled(w)))
    ends = F.transform(tail, lambda w: F.when(F.upper(w).rlike("^[IV]+$"), F.upper(w)).otherwise(F.concat(F.initcap(w), F.when(F.length(w) <= 3, ".").otherwise(""))))
    return F.when(F.size(core) > 0, F.array_join(F.concat(given, family, ends), " ")).otherwise(col(name))


def executives(owners: DataFrame, years: DataFrame) -> DataFrame:
    """(company, fiscal_year, executives): people reported within each fiscal year, with their last title and role, by rank.

    owners: company, owner, name, title, officer, director, period. years: company, fiscal_year, start, end.
    """
    j = interval_join(owners.where(~is_entity("name")), years, "company", "period", "start", "end", bucket_days=256)
    p = j.groupBy("company", "fiscal_year", "owner").agg(F.max_by("name", "period").alias("name"), F.max_by("title", "period").alias("title"), F.bool_or("officer").alias("officer"), F.bool_or("director").alias("director"))
    p = p.withColumn("role", role_of("title", "officer", "director"))
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role"))
    one = F.struct(rank.alias("rank"), readable_name("name").alias("name"), F.col("role").alias("role"), F.col("title").alias("title"))
    return p.groupBy("company", "fiscal_year").agg(F.sort_array(F.collect_list(one)).alias("executives"))


def insider_transactions(submissions: DataFrame, owners: DataFrame, transactions: DataFrame, companies: DataFrame) -> DataFrame:
    """One row for each transaction and owner, with its value and whether its date can't be right."""
    t = transactions.join(submissions, "accession").join(owners, "accession").join(companies, "cik")
    return t.withColumn("value", F.col("shares") * F.col("price")).withColumn("date_suspect", (F.col("trans_date") > F.col("filing_date")) | (F.col("trans_date") > F.current_date()))

"""Parsing wide tables of feature strings such as ``BINDING 10..20; /ligand="ATP"``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of the source and their types; types left out; types whose description is dropped.
FIELD_TYPES = {
    "ft_act_site": "Active site", "ft_binding": "Binding site", "ft_dna_bind": "DNA binding", "ft_site": "Site", "ft_mod_res": "Modified residue", "ft_carbohyd": "Glycosylation",
    "ft_lipid": "Lipidation", "ft_crosslnk": "Cross-link", "ft_disulfid": "Disulfide bond", "ft_helix": "Helix", "ft_strand": "Beta strand", "ft_turn": "Turn", "ft_coiled": "Coiled coil",
    "ft_region": "Region", "ft_motif": "Motif", "ft_repeat": "Repeat", "ft_compbias": "Compositional bias", "ft_intramem": "Intramembrane", "ft_transmem": "Transmembrane",
    "ft_topo_dom": "Topological domain", "ft_signal": "Signal peptide", "ft_transit": "Transit peptide", "ft_propep": "Propeptide", "ft_peptide": "Peptide", "ft_chain": "Chain",
    "ft_init_met": "Initiator methionine", "ft_domain": "Domain", "ft_zn_fing": "Zinc finger", "ft_variant": "Natural variant", "ft_var_seq": "Alternative sequence",
    "ft_mutagen": "Mutagenesis", "ft_conflict": "Sequence conflict", "ft_unsure": "Sequence uncertainty", "ft_non_cons": "Non-adjacent residues", "ft_non_ter": "Non-terminal residue",
}
LEFT_OUT = ("Chain", "Initiator methionine")
PLAIN = ("Mutagenesis", "Natural variant", "Alternative sequence", "Sequence conflict", "Sequence uncertainty", "Cross-link", "Disulfide bond")
LONGEST = 120


def long_form(wide: DataFrame, key: str = "accession") -> DataFrame:
    """accession, field, value for every feature column, named by field or by type, with or without `` [FT]``; the first column of a type counts."""
    types = {t.lower(): f for f, t in FIELD_TYPES.items()}
    fields: dict[str, str] = {}
    for name in wide.columns:
        plain = name.strip().removesuffix(" [FT]").removesuffix(" [ft]").lower()
        field = plain if plain in FIELD_TYPES else types.get(plain)
        if field and field not in fields.values():
            fields[name] = field
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{n}`").cast("string").alias("value")) for n, f in fields.items()])
    return wide.select(F.col(key).alias("accession"), F.inline(pairs))


def _once(df: DataFrame, kept: list[str], **made: Column) -> DataFrame:
    """``kept`` and the columns ``made``, worked out once for each row, where a plain projection is worked out again by each filter and use."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def parsed(long: DataFrame) -> DataFrame:
    """accession, feature_type, start, end, description, annot_subtype: a row for each entry of each value.

    Entries begin where a keyword is followed by white space and a digit.
    """
    names = F.create_map(*[F.lit(x) for pair in FIELD_TYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(names, F.col("field")), F.col("field"))
    typed = long.select("accession", kind.alias("feature_type"), F.trim("value").alias("value")).filter(~F.col("feature_type").isin(*LEFT_OUT) & F.col("value").isNotNull() & ~F.col("value").isin("", "-"))
    entries = typed.select("accession", "feature_type", F.explode(F.split("value", r"\s+(?=[A-Z_]{2,}\s+\d)")).alias("entry"))
    entries = _once(entries, ["accession", "feature_type"], entry=F.regexp_replace(F.trim("entry"), r"^[A-Z_]+\s+", ""))
    place = _once(entries, ["accession", "feature_type", "entry"], place=F.regexp_extract("entry", r"^(\d+(?:\.\.\d+)?)", 1)).filter("place != ''")
    start, end = F.expr("try_cast(split_part(place, '..', 1) AS int)"), F.expr("try_cast(split_part(place, '..', -1) AS int)")
    placed = _once(place, ["accession", "feature_type", "entry"], start=start, end=end).filter("start > 0 and end > 0 and end >= start")
    text = lambda what: F.when(F.contains("entry", F.lit(f'/{what}="')), F.regexp_extract("entry", f'/({what}="[^"]*)"', 1))
    marked = _once(placed, ["accession", "feature_type", "start", "end"], ligand=text("ligand"), note=text("note"), description=text("description"))
    value = lambda what: F.when(F.col(what) != "", F.trim(F.substring(what, len(what) + 3, 2**31 - 1)))
    ligand, note, description = value("ligand"), value("note"), value("description")
    raw = F.when(ligand.isNotNull() & note.isNotNull(), F.concat(ligand, F.lit("; "), note)).otherwise(F.coalesce(ligand, note, description, F.lit("")))
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(raw, r"\[ECO:[^\]]+\]", "")), r"(?i)^(By similarity|Probable|Potential)[;,]?\s*", ""))
    rows = _once(marked, ["accession", "feature_type", "start", "end"], description=F.left(clean, F.lit(LONGEST)))
    rows = rows.withColumn("description", F.when(F.col("feature_type").isin(*PLAIN), "").otherwise(F.col("description")))
    subtype = F.when(F.col("description") != "", F.concat("feature_type", F.lit(": "), "description")).otherwise(F.col("feature_type"))
    return rows.withColumn("annot_subtype", subtype)


def feature_strings(annotations: DataFrame, keyword: str = "SITE") -> DataFrame:
    """accession, value: the annotations of each accession written as one feature string."""
    entry = F.concat(F.lit(f"{keyword} "), F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"), F.lit('; /note="'), "description", F.lit('"; '))
    ordered = F.sort_array(F.collect_list(F.struct("start", "end", "description", entry.alias("entry"))))
    return annotations.groupBy("accession").agg(F.trim(F.array_join(ordered["entry"], "")).alias("value"))

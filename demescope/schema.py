"""Table shapes shared by the operators."""

from pyspark.sql import types as T

# A call as stored: one row per sample and variant, alleles as text codes.
CALLS = T.StructType(
    [
        T.StructField("sampleId", T.StringType()),
        T.StructField(
            "variant",
            T.StructType(
                [
                    T.StructField("contig", T.StructType([T.StructField("contigName", T.StringType())])),
                    T.StructField("start", T.LongType()),
                    T.StructField("end", T.LongType()),
                    T.StructField("referenceAllele", T.StringType()),
                    T.StructField("alternateAllele", T.StringType()),
                ]
            ),
        ),
        T.StructField("alleles", T.ArrayType(T.StringType())),
    ]
)

PANEL = T.StructType(
    [
        T.StructField("sample", T.StringType()),
        T.StructField("pop", T.StringType()),
        T.StructField("super_pop", T.StringType()),
        T.StructField("gender", T.StringType()),
    ]
)

SNP_PANEL = T.StructType(
    [
        T.StructField("contigName", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("id", T.LongType()),
    ]
)

VARIANT_SUMMARY = T.StructType(
    [
        T.StructField("snpIdx", T.LongType()),
        T.StructField("contigName", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("nonmissing", T.LongType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.StringType()),
        T.StructField("frequency", T.DoubleType()),
        T.StructField("genotype", T.ArrayType(T.StringType())),
    ]
)

# What identifies a variant in the long tables.
SITE = ["contig", "pos"]
VARIANT = ["contig", "pos", "ref_allele", "alt_allele"]

REF, ALT, OTHER_ALT = "Ref", "Alt", "OtherAlt"
UNKNOWN_REGION = "Unknown"

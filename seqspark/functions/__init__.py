"""Column-level functions (JVM-side expressions)."""
from seqspark.functions import dna, numeric, rand  # noqa: F401

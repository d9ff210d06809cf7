"""Sources and sinks: driver tables (views), FASTA / CSV / JSON files."""

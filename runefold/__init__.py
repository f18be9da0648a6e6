"""runefold: versioned key-value data on Spark, plus data-pipeline operators.

Sub-packages: ``operators`` (resolution, scans, compaction, sketches, change
feeds), ``sources`` (log and run readers/writers), ``functions`` (hashing,
codecs, checksums, text fingerprints), ``plans`` (registered queries and their
SQL twins), ``streaming`` (Structured Streaming forms).
"""

__version__ = "0.1.0"

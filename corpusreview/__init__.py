"""Review of source-code corpora as Spark jobs.

One row per file in, tables of smells, vulnerabilities, structure, metrics, prompts, reviews and reports out.
"""

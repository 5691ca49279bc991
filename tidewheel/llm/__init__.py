"""Operations for preparing training corpora, each a Spark job.

Nothing outside this subpackage imports it.
"""

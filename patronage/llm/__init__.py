"""Operations on training text: formatting, extraction, mixing, filters, tokens, near copies.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries only where the folder is present.
"""

from .text import (py_strip, py_word_count, py_words, na_to_null, to_numeric, nan_to_null,  # noqa: F401
                   letter_count, is_spam, spam_symbols_only, spam_repeated_char, spam_few_letters)
from .numeric import half_even, half_star, py_round, close_to_100, equal_width_bin  # noqa: F401

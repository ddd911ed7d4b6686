"""Column -> Column expressions: text/name normalisation and numeric coercion."""

from wideprep.functions.text import (normalize_text, normalize_name, match_key, id_match_key,
                                     starts_with_key, regex_any, contains_any,
                                     decimal_comma_to_double, significance_label, sign_label)
from wideprep.functions.numeric import (to_number, nan_to_null, is_integer_like, decimal_places,
                                        dtype_category, dtype_categories)

__all__ = ["normalize_text", "normalize_name", "match_key", "id_match_key", "starts_with_key",
           "regex_any", "contains_any", "decimal_comma_to_double", "significance_label", "sign_label",
           "to_number", "nan_to_null", "is_integer_like", "decimal_places", "dtype_category",
           "dtype_categories"]

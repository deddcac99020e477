"""DataFrame operators: detection, masking, lists, pages, evaluation, audit."""

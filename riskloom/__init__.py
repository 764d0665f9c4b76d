"""riskloom: find, score and report security problems in very large text and source collections."""

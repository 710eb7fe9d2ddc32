"""memoryloom: a PySpark-native engine for experience memory over coding-session transcripts."""

"""Readers of the formats that transcripts, ledgers, feeds and vocabularies come in, and writers of what is handed out."""

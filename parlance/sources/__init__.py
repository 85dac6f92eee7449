"""Sources: transcripts, frame tables, media descriptions, labels and notes."""

"""Where tables come from: schemas, recorded metadata, WAV files, and the domain view of the star-schema tables."""

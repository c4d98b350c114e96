"""Files into documents: manifest, record mapping, text parsing, sidecars, external datasets."""

"""Files as a stream: what is new below a folder becomes documents and chunks, each file once."""

"""A stand-in for a store's client."""


class Client:
    data = {f"user:{i}": str(i * i) for i in range(10)} | {"other:1": "x"}

    def __init__(self, options):
        self.options = options

    def scan(self, part, parts, batch):
        yield from ((k, v) for n, (k, v) in enumerate(sorted(self.data.items())) if n % parts == part)

    def end(self):
        return len(self.data)

    def log(self, start, end):
        return list(sorted(self.data.items()))[start:end]

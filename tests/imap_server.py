"""A small IMAP server for tests: folders of messages in memory, read-only."""

import re
import socketserver
import threading


class Handler(socketserver.StreamRequestHandler):
    def send(self, *lines):
        for line in lines:
            self.wfile.write((line if isinstance(line, bytes) else line.encode()) + b"\r\n")

    def handle(self):
        box = None
        self.send("* OK ready")
        for raw in self.rfile:
            tag, _, rest = raw.decode().strip().partition(" ")
            word, _, rest = rest.partition(" ")
            word = word.upper()
            server = self.server
            server.seen.append(word)
            if word == "CAPABILITY":
                self.send("* CAPABILITY IMAP4rev1 X-GM-EXT-1")
            elif word == "LOGIN":
                if server.password not in rest:
                    self.send(f"{tag} NO wrong")
                    continue
            elif word == "LIST":
                for name in server.folders:
                    self.send(f'* LIST (\\HasNoChildren) "/" "{name}"')
            elif word in ("EXAMINE", "SELECT"):
                name = rest.strip().strip('"')
                if name not in server.folders:
                    self.send(f"{tag} NO no such folder")
                    continue
                box = server.folders[name]
                self.send(f"* {len(box['messages'])} EXISTS")
                if box["uidvalidity"]:
                    self.send(f"* OK [UIDVALIDITY {box['uidvalidity']}] valid")
            elif word == "UID" and rest.upper().startswith("SEARCH"):
                self.send("* SEARCH " + " ".join(map(str, box["messages"])))
            elif word == "UID":
                for n, uid in enumerate(int(u) for u in rest.split()[1].split(",")):
                    if uid in server.broken:
                        self.send(f"{tag} NO broken")
                        break
                    m = box["messages"].get(uid)
                    if m:
                        labels = " ".join('"' + re.sub(r'(["\\])', r"\\\1", x) + '"' for x in m["labels"])
                        head = f'* {n + 1} FETCH (UID {uid} X-GM-THRID {m["thread"]} X-GM-MSGID {uid + 9000} X-GM-LABELS ({labels}) INTERNALDATE "{m["date"]}" RFC822.SIZE {len(m["raw"])} BODY[] {{{len(m["raw"])}}}'
                        self.wfile.write(head.encode() + b"\r\n" + m["raw"])
                        self.send(" FLAGS (\\Seen))")
                else:
                    self.send(f"{tag} OK done")
                continue
            elif word == "LOGOUT":
                self.send("* BYE", f"{tag} OK done")
                return
            self.send(f"{tag} OK done")


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = daemon_threads = True

    def __init__(self, folders, password="open sesame"):
        super().__init__(("127.0.0.1", 0), Handler)
        self.folders, self.password, self.broken, self.seen = folders, password, set(), []
        threading.Thread(target=self.serve_forever, daemon=True).start()

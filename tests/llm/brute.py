"""Plain versions of the operators, for small tables."""

import re,hashlib,collections
def op9(texts,L=400):
    cnt=collections.Counter(); raws=[(t or "").encode() for t in texts]
    for r in raws:
        for i in range(len(r)-L+1): cnt[hash(r[i:i+L])]+=1
    out=[]
    for r in raws:
        cov=bytearray(len(r)); last=-1
        for i in range(len(r)-L+1):
            if cnt[hash(r[i:i+L])]>1:
                for p in range(max(i,last),i+L): cov[p]=1
                last=i+L
        spans=sum(1 for i in range(len(r)) if cov[i] and (i==0 or not cov[i-1]))
        out.append((len(r),sum(cov),spans,hashlib.sha256(bytes(b for b,c in zip(r,cov) if not c)).hexdigest()))
    return out
U=str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ","abcdefghijklmnopqrstuvwxyz")
RX=re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
def op4(texts,items,W=13):
    win=collections.defaultdict(set)
    for i,t in items:
        w=RX.findall((t or "").translate(U))
        for k in range(max(1,len(w)-W+1) if w else 0): win[tuple(w[k:k+W])].add(i)
    sizes={len(k) for k in win}
    out=[]
    for t in texts:
        w=RX.findall((t or "").translate(U)); hit=set(); ids=set()
        for n in sizes:
            for k in range(len(w)-n+1):
                x=win.get(tuple(w[k:k+n]))
                if x: hit.update(range(k,k+n)); ids|=x
        out.append((len(w),len(hit),len(ids),hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest(),len(hit)>0 and 20*len(hit)>=len(w)))
    return out
def op10(ids,texts,k=2,pc=80):
    S=[]
    for t in texts:
        w=re.findall(r"[^\x20\x09-\x0D]+",(t or "").translate(U))
        S.append({tuple(w[i:i+k]) for i in range(len(w)-k+1)} if len(w)>=k else ({tuple(w)} if w else set()))
    inv=collections.defaultdict(list); par=list(range(len(ids)))
    def f(x):
        while par[x]!=x: par[x]=par[par[x]]; x=par[x]
        return x
    for i,s in enumerate(S):
        c=collections.Counter()
        for g in s:
            for j in inv[g]: c[j]+=1
            inv[g].append(i)
        for j,n in c.items():
            if 100*n>=pc*(len(s)+len(S[j])-n): par[f(i)]=f(j)
    comp={}
    for i,d in enumerate(ids): comp[f(i)]=min(comp.get(f(i),d),d)
    return [(len(s),comp[f(i)],comp[f(i)]==ids[i]) for i,s in enumerate(S)]
def op5(t):
    w=re.findall(r"[^\x20\x09-\x0D]+",t or ""); c=collections.Counter(tuple(w[i:i+8]) for i in range(len(w)-7)); r=set()
    for i in range(len(w)-7):
        if c[tuple(w[i:i+8])]>1: r.update(range(i,i+8))
    L=[l for l in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]",l)]
    return (len(w),sum(map(len,w)),sum((t or "").count(x) for x in "#*$%&|<>"),len(L)-len(set(L)),len(r),len(w)<20 or 100*len(r)>30*len(w))
